"""DuckDB oracle for the prompt-signal keys (inputs: ``seeded_prompts``).

RE2 has no lookaround or backreference, so those rules get other forms here:
spaced letters by span rebuild, leet-mix by token filter, repeated characters
by a position loop.  NFKC is approximated by ``nfc_normalize`` (DuckDB has no
NFKC); the driver tables hold no compatibility characters.
"""
from __future__ import annotations

from textsieve.functions import dialect as D
from textsieve.functions import patterns as P
from textsieve.functions.spans import oracle_spans_sql
from textsieve.sources.tables import cte_prefix

WS = f"[{D.RE2_WS}]"
HG_FROM = "".join(k for k, _ in P.HOMOGLYPHS)
HG_TO = "".join(v for _, v in P.HOMOGLYPHS)
VERBS = r"\b(" + "|".join(P.IMPERATIVE_VERBS) + r")\b"


def q(s: str) -> str:
    return D.sql_str(s)


def rx(pattern: str, flags: str = "") -> str:
    return q(D.re2(pattern, flags))


def wv(e: str) -> str:
    return D.re2_word_view(e)


def matches(e: str, pattern: str, flags: str = "", word: bool = True) -> str:
    return f"regexp_matches({wv(e) if word else e}, {rx(pattern, flags)})"


def count(e: str, pattern: str, flags: str = "", word: bool = True) -> str:
    return f"len(regexp_extract_all({wv(e) if word else e}, {rx(pattern, flags)}))"


def collapse_spaced(t: str, only_space: bool = False) -> str:
    sp = oracle_spans_sql(wv(t), D.re2(P.SPACED_LETTERS))
    strip = q(" ") if only_space else q(WS)
    return (f"(SELECT list_aggregate(list_transform(range(1, len(sp) + 2), lambda i: "
            f"substr({t}, CASE WHEN i = 1 THEN 1 ELSE sp[i - 1]['end'] + 1 END, "
            f"(CASE WHEN i = len(sp) + 1 THEN length({t}) ELSE sp[i]['start'] END) - "
            f"(CASE WHEN i = 1 THEN 0 ELSE sp[i - 1]['end'] END)) || "
            f"CASE WHEN i <= len(sp) THEN regexp_replace(substr({t}, sp[i]['start'] + 1, "
            f"sp[i]['end'] - sp[i]['start']), {strip}, '', 'g') ELSE '' END), 'string_agg', '') "
            f"FROM (SELECT {sp} AS sp))")


def normalize(raw: str) -> str:
    low = f"lower(translate(nfc_normalize({raw}), {q(HG_FROM + P.ZERO_WIDTH_CHARS)}, {q(HG_TO)}))"
    t = collapse_spaced(low)
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '([!?.]){{2,}}', '\\1', 'g')"
    return f"regexp_replace({t}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {q(WS + '+')}), lambda x: x <> '')"


def leet_mix_count(raw: str) -> str:
    toks = f"regexp_extract_all({wv(raw)}, '[\\p{{L}}\\p{{N}}_]+@?')"
    return (f"len(list_filter({toks}, lambda x: regexp_matches(x, '[a-zA-Z]') AND "
            f"(regexp_matches(x, '[013457]') OR x LIKE '%@')))")


def evasions(raw: str) -> dict[str, str]:
    return {
        "homoglyph": f"(length({raw}) - length(translate({raw}, {q(HG_FROM)}, '')))",
        "zero_width": f"(length({raw}) - length(translate({raw}, {q(P.ZERO_WIDTH_CHARS)}, '')))",
        "leet_mix": leet_mix_count(raw),
        "spaced_letters": count(raw, P.SPACED_LETTERS),
    }


def filler_repeat(t: str) -> str:
    # (.)\1{15,}: some position starts 16 equal non-newline characters
    return (f"(length({t}) >= 16 AND list_bool_or(list_transform(range(1, length({t}) - 14), lambda i: "
            f"substr({t}, i, 1) <> chr(10) AND substr({t}, i, 16) = repeat(substr({t}, i, 1), 16))))")


def entropy(tok: str) -> str:
    ch = f"regexp_extract_all({tok}, '(?s).')"
    return (f"(0.0 - list_sum(list_transform(list_distinct({ch}), lambda c: "
            f"(len(list_filter({ch}, lambda x: x = c)) / len({ch})) * "
            f"log2(len(list_filter({ch}, lambda x: x = c)) / len({ch})))))")


def fmt2(e: str, d: int = 2) -> str:
    return f"printf('%.{d}f', {e})"


def views_cte(src: str = "seeded_prompts", key: str = "request_id", text: str = "prompt") -> str:
    inners = "flatten([" + ", ".join(
        f"regexp_extract_all(raw, {rx(p, f)}, 1)" for p, f in P.EMBEDDED_BLOCK_PATTERNS) + "])"
    strip = q('^' + WS + '+|' + WS + '+$')
    return (f"pv0 AS (SELECT {key} AS k, {text} AS raw, {normalize(text)} AS norm FROM {src}),\n"
            f"pv AS (SELECT *, translate(norm, {q(P.LEET_FROM)}, {q(P.LEET_TO)}) AS leet FROM pv0),\n"
            f"inn AS (SELECT k, unnest({inners}) AS x FROM pv),\n"
            f"emb AS (SELECT DISTINCT k FROM inn WHERE regexp_replace(x, {strip}, '', 'g') <> '' "
            f"AND {matches(normalize('x'), VERBS)})")


def category_rx(pats) -> str:
    return "|".join(f"(?:{p})" for p in pats)


def signal_exprs() -> list[tuple[str, str, str, str]]:
    """(category, condition, weight, evidence-list) over columns raw/norm/leet."""
    out = []
    for name, weight, pats, _ph in P.CATEGORIES:
        r = category_rx(pats)
        cond = f"({matches('norm', r)} OR (leet <> norm AND {matches('leet', r)}))"
        out.append((name, cond, str(weight), f"[{q(f'category={name} concept=lexical_match confidence=0.95')}]"))
    lang_case = "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(raw, {q(ph)})' for ph in phs)} THEN {q(lang)}"
        for lang, phs in P.MULTILINGUAL_KEYWORDS) + " END"
    out.append(("multilingual_override", f"({lang_case}) IS NOT NULL", "35",
                f"['category=multilingual_override concept=lang=' || ({lang_case}) || ' phrase_match confidence=0.75']"))
    out.append(("embedded_instruction", "k IN (SELECT k FROM emb)", "40",
                "['category=embedded_instruction concept=hidden_directive_in_markup confidence=0.85']"))
    struct = " OR ".join(matches("raw", p, f) for p, f in P.STRUCTURAL_PATTERNS)
    out.append(("structural_delimiter", f"({struct})", "20",
                "['category=structural_delimiter concept=fake_role_markup confidence=0.80']"))
    toks = f"regexp_extract_all(raw, {rx(P.LONG_TOKEN)})"
    blobs = f"list_filter({toks}, lambda t: {entropy('t')} >= {P.ENTROPY_THRESHOLD})"
    first = f"({blobs})[1]"
    enc = ("list_filter([" + ", ".join([
        f"CASE WHEN {matches('raw', P.BASE64_BLOB, word=False)} THEN 'category=encoded_payload concept=base64_blob confidence=0.70' END",
        f"CASE WHEN {matches('raw', P.HEX_BLOB, word=False)} THEN 'category=encoded_payload concept=hex_blob confidence=0.60' END",
        f"CASE WHEN {matches('norm', P.ROT13_HINT, 'I')} THEN 'category=encoded_payload concept=rot13_hint confidence=0.60' END",
        f"CASE WHEN len({blobs}) > 0 THEN 'category=encoded_payload concept=high_entropy_blob(entropy=' || "
        f"{fmt2(entropy(first))} || ',len=' || CAST(length({first}) AS VARCHAR) || ') confidence=0.65' END",
    ]) + "], lambda x: x IS NOT NULL)")
    out.append(("encoded_payload", f"len({enc}) > 0", "20", enc))
    has_url = matches("raw", P.URL, word=False)
    ctx = matches("raw", P.URL_INSTRUCTION_CONTEXT, "I")
    out.append(("external_instruction_source", has_url, f"CASE WHEN {ctx} THEN 35 ELSE 10 END",
                f"CASE WHEN {ctx} THEN ['category=external_instruction_source concept=url_with_instruction_context confidence=0.80'] "
                f"ELSE ['category=external_instruction_source concept=bare_url confidence=0.30'] END"))
    seq = f"({count('norm', P.SEQUENCE_MARKER, 'I')} >= 2 AND {count('norm', VERBS)} >= 2)"
    out.append(("multi_stage_execution_chain", seq, "30",
                "['category=multi_stage_execution_chain concept=chained_imperatives confidence=0.70']"))
    roles = f"regexp_extract_all({wv('raw')}, {rx(P.ROLE_LINE, 'IM')}, 1)"
    out.append(("role_transition_spoofing", f"len(list_distinct(list_transform({roles}, lambda r: lower(r)))) >= 2",
                "30", "['category=role_transition_spoofing concept=multiple_role_markers confidence=0.70']"))
    contra = " OR ".join(f"({matches('norm', rf'\b{a}\b')} AND {matches('norm', rf'\b{b}\b')})"
                         for a, b in P.CONTRADICTION_PAIRS)
    out.append(("semantic_contradiction", f"({contra})", "25",
                "['category=semantic_contradiction concept=contradictory_verb_pair confidence=0.65']"))
    w = words("norm")
    ts = f"CAST(trunc(len({w}) * CAST({1 - P.CONTEXT_STUFF_TAIL_FRACTION} AS DOUBLE)) AS INTEGER)"
    head = f"array_to_string(({w})[1:{ts}], ' ')"
    tail = f"array_to_string(({w})[{ts} + 1:], ' ')"
    stuff = (f"({filler_repeat('norm')} OR {matches('norm', P.REPEAT_N_TIMES, 'I', word=False)} OR "
             f"(len({w}) >= {P.CONTEXT_STUFF_MIN_WORDS} AND {matches(tail, VERBS)} AND NOT {matches(head, VERBS)}))")
    out.append(("context_window_stuffing", stuff, "25",
                "['category=context_window_stuffing concept=filler_then_payload confidence=0.65']"))
    ev = evasions("raw")
    total = f"({ev['homoglyph']} + {ev['zero_width']} + {ev['leet_mix']} + {ev['spaced_letters']})"
    note = (f"'homoglyphs=' || CAST({ev['homoglyph']} AS VARCHAR) || ',zero_width=' || CAST({ev['zero_width']} AS VARCHAR)"
            f" || ',leet=' || CAST({ev['leet_mix']} AS VARCHAR) || ',spaced=' || CAST({ev['spaced_letters']} AS VARCHAR)")
    out.append(("obfuscation_evasion", f"{total} >= 5", f"CASE WHEN {total} < 15 THEN 20 ELSE 30 END",
                f"['category=obfuscation_evasion concept=' || {note} || ' confidence=0.70']"))
    stats = statistical_list()
    out.append(("statistical_anomaly", f"len({stats}) > 0", "15",
                f"list_transform({stats}, lambda s: 'category=statistical_anomaly concept=' || s || ' confidence=0.50')"))
    return out


def sentence_count(t: str) -> str:
    return (f"len(list_filter(regexp_split_to_array({t}, {rx(P.SENTENCE_SPLIT)}), lambda s: "
            f"regexp_replace(s, {q('^' + WS + '+|' + WS + '+$')}, '', 'g') <> ''))")


def statistical_list() -> str:
    verbs = count("norm", VERBS)
    sents = sentence_count("norm")
    density = f"(CASE WHEN {sents} > 0 THEN {verbs} / {sents} ELSE 0.0 END)"
    caps = f"(length(regexp_replace(raw, '[^\\p{{Lu}}]', '', 'g')) / length(raw))"
    return ("list_filter([" + ", ".join([
        f"CASE WHEN {verbs} >= 3 THEN 'high imperative-verb density (' || CAST({verbs} AS VARCHAR) || ' hits)' END",
        f"CASE WHEN {density} >= 1.2 THEN 'instruction density ' || {fmt2(density)} || ' verbs/sentence' END",
        f"CASE WHEN length(raw) > 20 AND {caps} > 0.4 THEN 'excessive ALL CAPS' END",
        f"CASE WHEN {matches('raw', P.EXCESS_PUNCT, word=False)} THEN 'excessive punctuation' END",
        f"CASE WHEN {count('raw', P.TAG_ABUSE, word=False)} >= 3 THEN 'markdown/XML tag abuse' END",
    ]) + "], lambda x: x IS NOT NULL)")


def signals_cte() -> str:
    rows = []
    for i, (cat, cond, weight, ev) in enumerate(signal_exprs()):
        rows.append(f"SELECT k, {i} AS pos, {q(cat)} AS category, CAST({weight} AS INTEGER) AS weight, "
                    f"{ev} AS evidence FROM pv WHERE {cond}")
    return "sig AS (\n" + "\nUNION ALL\n".join(rows) + "\n)"


def result_cte() -> str:
    meta = matches("norm", P.META_DISCUSSION, "I")
    quoted = f"({matches('raw', P.QUOTED_ATTACK_PHRASE, word=False)} AND contains(raw, '?'))"
    hedge = " + ".join(f"CAST(contains(norm, {q(w)}) AS INTEGER)" for w in P.HEDGE_WORDS)
    return f"""agg AS (SELECT k, least(100, sum(weight)) AS raw_score,
        list_sort(list(category)) AS cats,
        flatten(list(evidence ORDER BY pos)) AS ev FROM sig GROUP BY k),
damp AS (SELECT a.*, pv.raw, pv.norm, ({meta} OR {quoted}) AS edu, ({hedge}) AS hedge_hits FROM agg a JOIN pv ON pv.k = a.k),
damp2 AS (SELECT *, CASE WHEN hedge_hits = 0 THEN 1.0::DOUBLE ELSE greatest(0.4::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * hedge_hits) END AS factor FROM damp),
scored AS (SELECT *, CASE WHEN edu THEN greatest(1, CAST(trunc(raw_score * CAST({P.EDUCATIONAL_FACTOR} AS DOUBLE)) AS INTEGER))
        WHEN factor < 1.0 THEN greatest(1, CAST(trunc(raw_score * factor) AS INTEGER)) ELSE raw_score END AS score FROM damp2),
res AS (SELECT k, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS severity,
        cats, ev, edu, factor FROM scored)"""


def prompt_rules_sql(src="seeded_prompts", key="request_id", text="prompt", pre=None) -> str:
    pre = pre if pre is not None else cte_prefix("seeded_prompts").rstrip() + ",\n"
    return pre + views_cte(src, key, text) + ",\n" + signals_cte() + ",\n" + result_cte()


def candidates_sql() -> str:
    """Word windows and phrases as tables, joined by the windows' width under both bounds."""
    rows = []
    for i, (name, _w, _p, phrases) in enumerate(P.CATEGORIES):
        rows += [f"({i}, {q(name)}, {q(ph)}, {len(ph.split()) + 3})" for ph in phrases]
    th = f"CAST({P.FUZZY_THRESHOLD} AS DOUBLE)"
    w = words("norm")
    return f"""
, ph AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v(pos, category, phrase, width)),
letters AS (SELECT phrase, ch, count(*) AS n FROM (SELECT phrase, unnest(regexp_extract_all(phrase, '(?s).')) AS ch
            FROM (SELECT DISTINCT phrase FROM ph)) GROUP BY phrase, ch),
ws AS (SELECT k, norm, {w} AS w FROM pv),
win AS (SELECT DISTINCT k, width, CASE WHEN len(w) > width + 1 THEN array_to_string(w[i:i + width - 1], ' ') ELSE norm END AS win
        FROM (SELECT k, norm, w, width, unnest(CASE WHEN len(w) > width + 1 THEN range(1, len(w) - width + 2) ELSE [1] END) AS i
              FROM ws, (SELECT DISTINCT width FROM ph))),
near AS (SELECT win.k, ph.category, ph.phrase, win.win FROM win JOIN ph ON ph.width = win.width
         WHERE 2 * least(length(phrase), length(win)) / CAST(length(phrase) + length(win) AS DOUBLE) >= {th}
           AND NOT EXISTS (SELECT 1 FROM sig WHERE sig.k = win.k AND sig.category = ph.category)),
met AS (SELECT n.k, n.category, n.phrase, n.win, sum(least(l.n, length(n.win) - length(replace(n.win, l.ch, '')))) AS shared
        FROM near n JOIN letters l ON l.phrase = n.phrase GROUP BY ALL)
SELECT k AS request_id, category, phrase, win AS "window" FROM met
WHERE 2 * shared / CAST(length(phrase) + length(win) AS DOUBLE) >= {th}"""


def model_ctes() -> str:
    """CTE prob (k, p): naive Bayes log-odds of the labelled documents' terms, summed over the distinct terms of each prompt."""
    def terms(t: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^a-zA-Z0-9_]+'), lambda x: x <> ''))"
    return f"""lab AS (SELECT text, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IN (0, 1)),
tot AS (SELECT sum(y) AS n1, sum(1 - y) AS n0 FROM lab),
tc AS (SELECT term, sum(y) AS c1, sum(1 - y) AS c0 FROM (SELECT y, unnest({terms('text')}) AS term FROM lab) GROUP BY term),
tw AS (SELECT term, ln((c1 + 1) / (n1 + 2)) - ln((c0 + 1) / (n0 + 2)) AS weight FROM tc, tot),
pt AS (SELECT k, unnest({terms('norm')}) AS term FROM pv WHERE norm <> ''),
ps AS (SELECT k, sum(weight) AS s FROM pt JOIN tw USING (term) GROUP BY k),
prob AS (SELECT pv.k, CASE WHEN norm <> '' THEN 1 / (1 + exp(-(coalesce(s, 0) + ln(n1 + 1) - ln(n0 + 1)))) END AS p
         FROM pv LEFT JOIN ps ON ps.k = pv.k, tot)"""


def semantic_sql() -> dict[str, str]:
    pre = cte_prefix("seeded_prompts").rstrip() + ",\n" + views_cte() + ",\n" + model_ctes()
    weight = (f"CASE WHEN p > {P.SEMANTIC_HIGH_PROB} THEN {P.SEMANTIC_HIGH_WEIGHT} WHEN p > {P.SEMANTIC_MED_PROB} "
              f"THEN {P.SEMANTIC_MED_WEIGHT} WHEN p IS NOT NULL THEN 0 END")
    return {
        "semantic_classifier": pre + "\nSELECT k AS request_id, round(p, 6) AS p_injection FROM prob",
        "semantic_weight": pre + ",\n" + signals_cte().replace("sig AS (", "sig0 AS (", 1) + f""",
sem AS (SELECT k, {weight} AS w FROM prob),
sig AS (SELECT * FROM sig0 UNION ALL SELECT k, 99, 'semantic_classifier', w, CAST([] AS VARCHAR[]) FROM sem WHERE w > 0),
{result_cte()}
SELECT sem.k AS request_id, CAST(w AS BIGINT) AS semantic_weight, CAST(coalesce(res.score, 0) AS BIGINT) AS score
FROM sem LEFT JOIN res ON res.k = sem.k""",
    }


def prompt_sql() -> dict[str, str]:
    base = prompt_rules_sql()
    ev = evasions("raw")
    out = {
        "normalize_text": base + "\nSELECT k AS request_id, norm FROM pv",
        "leet_view": base + "\nSELECT k AS request_id, leet FROM pv",
        "spaced_letters": base + f"\nSELECT k AS request_id, {collapse_spaced('lower(raw)')} AS collapsed FROM pv "
                                 f"WHERE {count('lower(raw)', P.SPACED_LETTERS)} > 0",
        "evasion_counts": base + "\nSELECT k AS request_id, " + ", ".join(
            f"CAST({v} AS BIGINT) AS {n}" for n, v in ev.items()) + " FROM pv",
        "sentence_stats": base + f"\nSELECT k AS request_id, CAST({sentence_count('norm')} AS BIGINT) AS n_sentences, "
                                 f"CAST({count('norm', VERBS)} AS BIGINT) AS n_verbs, "
                                 f"round(CASE WHEN {sentence_count('norm')} > 0 THEN {count('norm', VERBS)} / "
                                 f"{sentence_count('norm')} ELSE 0.0 END, 6) AS density FROM pv",
        "category_lexical": base + "\nSELECT k AS request_id, category FROM sig WHERE pos < 8",
        "paraphrase_candidates": base + candidates_sql(),
        "multilingual_hits": base + "\nSELECT k AS request_id, regexp_extract(evidence[1], 'lang=([a-z]+)', 1) AS lang "
                                    "FROM sig WHERE category = 'multilingual_override'",
        "embedded_instruction": base + "\nSELECT k AS request_id FROM sig WHERE category = 'embedded_instruction'",
        "structural_delimiter": base + "\nSELECT k AS request_id FROM sig WHERE category = 'structural_delimiter'",
        "encoded_payload": base + "\nSELECT k AS request_id, unnest(evidence) AS evidence FROM sig WHERE category = 'encoded_payload'",
        "entropy_tokens": base + f"""
SELECT DISTINCT k AS request_id, tok, round({entropy('tok')}, 6) AS entropy, CAST(length(tok) AS BIGINT) AS len
FROM (SELECT k, unnest(regexp_extract_all(raw, {rx(P.LONG_TOKEN)})) AS tok FROM pv) WHERE {entropy('tok')} >= {P.ENTROPY_THRESHOLD}""",
        "url_signal": base + "\nSELECT k AS request_id, CAST(weight AS BIGINT) AS weight FROM sig WHERE category = 'external_instruction_source'",
        "sequence_chain": base + "\nSELECT k AS request_id FROM sig WHERE category = 'multi_stage_execution_chain'",
        "role_transition": base + "\nSELECT k AS request_id FROM sig WHERE category = 'role_transition_spoofing'",
        "contradiction": base + "\nSELECT k AS request_id FROM sig WHERE category = 'semantic_contradiction'",
        "context_stuffing": base + "\nSELECT k AS request_id FROM sig WHERE category = 'context_window_stuffing'",
        "obfuscation_evasion": base + "\nSELECT k AS request_id, CAST(weight AS BIGINT) AS weight, evidence[1] AS evidence FROM sig WHERE category = 'obfuscation_evasion'",
        "statistical_anomaly": base + "\nSELECT k AS request_id, unnest(evidence) AS evidence FROM sig WHERE category = 'statistical_anomaly'",
        "educational_dampening": base + "\nSELECT k AS request_id, CASE WHEN edu THEN 'educational' ELSE 'hedge=' || printf('%.2f', factor) END AS dampening FROM res WHERE edu OR factor < 1.0",
        "prompt_rules": base + """
SELECT pv.k AS request_id, res.k IS NOT NULL AS matched, CAST(coalesce(res.score, 0) AS BIGINT) AS score,
       res.severity, coalesce(array_to_string(res.cats, ','), '') AS categories,
       coalesce(array_to_string(list_concat(['severity=' || res.severity || ' aggregate_score=' || CAST(res.score AS VARCHAR)
         || ' categories=[' || array_to_string(list_transform(res.cats, lambda c: '''' || c || ''''), ', ') || ']'],
         res.ev, CASE WHEN res.edu THEN ['dampened: reads as educational/meta discussion, not an attempt']
                      WHEN res.factor < 1.0 THEN ['dampened: hedge_factor=' || printf('%.2f', res.factor) || ' (citation/example language present)']
                      ELSE [] END), ' | '), '') AS evidence
FROM pv LEFT JOIN res ON res.k = pv.k""",
    }
    out.update(semantic_sql())
    return out
