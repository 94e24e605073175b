"""DuckDB oracle for the document-injection keys (inputs: ``seeded_docs``).

Independent formulation of the document pipeline for Latin-1 text (all rows of
the driver tables): the normalizer's deletions (blank runs, spaced letters) are
built from spans, offsets mapped through the deletion list, signatures run as
RE2 on the word view, decoding uses TRY(from_base64/unhex), dampening is a
containment test, merge is window gaps-and-islands, scoring is SQL arithmetic.
"""
from __future__ import annotations

from textsieve.functions import dialect as D
from textsieve.functions import patterns as P
from textsieve.functions.spans import oracle_spans_sql
from textsieve.operators.rag import ORD_DECODED, ORD_EMBEDDED, ORD_ENC, ORD_MULTI, ORD_SEMANTIC, ORD_URL
from textsieve.plans import oracle_prompt as OP
from textsieve.sources.tables import cte_prefix

q, rx, wv, WS = OP.q, OP.rx, OP.wv, OP.WS
STRIP = q("^" + WS + "+|" + WS + "+$")


def _sig_defs():
    out = []
    for sid, sev, pat, flags in P.RAG_SIGNATURES:
        out.append((sid, sev, pat, flags))
    for name, weight, pats, _ph in P.CATEGORIES:
        for pat in pats:
            out.append((name, weight, pat, ""))
    for pat, flags in P.STRUCTURAL_PATTERNS:
        out.append(("structural_delimiter", 20, pat, flags))
    return out


SIGS = _sig_defs()


def n5_ctes(src: str, key: str, text: str, prefix: str = "d") -> str:
    """CTEs {prefix}0/{prefix}1: k, raw, dels, norm, ndels, leet."""
    chain = oracle_spans_sql(wv("lower(raw)"), D.re2(P.SPACED_LETTERS))
    blank = oracle_spans_sql("raw", "[ \\t]{2,}")
    chain_dels = (f"flatten(list_transform({chain}, lambda cs: list_transform(list_filter("
                  f"range(cs['start'], cs['end']), lambda i: substr(raw, i + 1, 1) = ' '), "
                  f"lambda i: {{'s': i, 'e': i + 1}})))")
    blank_dels = f"list_transform({blank}, lambda b: {{'s': b['start'] + 1, 'e': b['end']}})"
    norm = ("lower(replace(list_aggregate(list_transform(range(1, len(dels) + 2), lambda i: "
            "substr(raw, CASE WHEN i = 1 THEN 1 ELSE dels[i - 1]['e'] + 1 END, "
            "(CASE WHEN i = len(dels) + 1 THEN length(raw) ELSE dels[i]['s'] END) - "
            "(CASE WHEN i = 1 THEN 0 ELSE dels[i - 1]['e'] END))), 'string_agg', ''), chr(9), ' '))")
    ndels = ("list_transform(range(1, len(dels) + 1), lambda i: {'nstart': dels[i]['s'] - "
             "coalesce(list_sum(list_transform(dels[1:i - 1], lambda x: x['e'] - x['s'])), 0), "
             "'cum': list_sum(list_transform(dels[1:i], lambda x: x['e'] - x['s']))})")
    return (f"{prefix}0 AS (SELECT {key} AS k, {text} AS raw, list_sort(list_concat({chain_dels}, {blank_dels})) "
            f"AS dels FROM {src}),\n"
            f"{prefix}1 AS (SELECT *, {norm} AS norm, {ndels} AS ndels FROM {prefix}0),\n"
            f"{prefix} AS (SELECT *, translate(norm, {q(P.LEET_FROM)}, {q(P.LEET_TO)}) AS leet FROM {prefix}1)")


def orig(kexpr: str) -> str:
    return (f"({kexpr} + coalesce(list_max(list_transform(list_filter(ndels, lambda dd: dd['nstart'] <= {kexpr}), "
            f"lambda dd: dd['cum'])), 0))")


def mapped(spans: str) -> str:
    k_start = "sp['start']"
    k_last = "least(sp['end'], length(norm)) - 1"
    st = f"CASE WHEN sp['start'] < length(norm) THEN {orig(k_start)} ELSE length(raw) END"
    en = f"CASE WHEN sp['end'] <= sp['start'] THEN ({st}) ELSE {orig(k_last)} + 1 END"
    return (f"list_transform({spans}, lambda sp: CASE WHEN length(norm) = 0 THEN sp ELSE "
            f"{{'start': {st}, 'end': {en}}} END)")


def _rows(ord_, sid_sql, sev_sql, spans_sql, src="d", where="TRUE") -> str:
    return (f"SELECT k, {ord_} AS ord, {sid_sql} AS sid, {sev_sql} AS sev, m['start'] AS s, m['end'] AS e "
            f"FROM (SELECT k, unnest({spans_sql}) AS m FROM {src} WHERE {where})")


def signature_rows(src="d") -> list[str]:
    out = []
    for i, (sid, sev, pat, flags) in enumerate(SIGS):
        for v, view in enumerate(("norm", "leet")):
            sp = oracle_spans_sql(wv(view), D.re2(pat, flags))
            out.append(_rows(2 * i + v, q(sid), sev, mapped(sp), src, "leet <> norm" if v else "TRUE"))
    return out


def embedded_rows(src="d") -> list[str]:
    out = []
    for i, (pat, flags) in enumerate(P.EMBEDDED_BLOCK_PATTERNS):
        r = D.re2(pat, flags)
        sp = oracle_spans_sql(wv("norm"), r)
        inner = f"regexp_extract_all({wv('norm')}, {q(r)}, 1)"
        keep = (f"list_transform(list_filter(range(1, len(inr) + 1), lambda i: "
                f"regexp_replace(inr[i], {STRIP}, '', 'g') <> '' AND "
                f"regexp_matches(inr[i], {rx(OP.VERBS)})), lambda i: spl[i])")
        out.append(f"SELECT k, {ORD_EMBEDDED + i} AS ord, 'embedded_instruction' AS sid, {P.EMBEDDED_SEVERITY} AS sev, "
                   f"m['start'] AS s, m['end'] AS e FROM (SELECT k, unnest({mapped(keep)}) AS m FROM "
                   f"(SELECT *, {sp} AS spl, {inner} AS inr FROM {src}))")
    return out


def raw_rows(src="d", raw="raw") -> list[str]:
    out, k = [], 0
    for _lang, phrases in P.MULTILINGUAL_KEYWORDS:
        for ph in phrases:
            sp = oracle_spans_sql(raw, "\\Q" + ph + "\\E")
            out.append(_rows(ORD_MULTI + k, "'multilingual_override'", P.MULTILINGUAL_SEVERITY, sp, src))
            k += 1
    ctx = oracle_spans_sql(wv(raw), D.re2(P.URL_INSTRUCTION_CONTEXT, "I"))
    bare = oracle_spans_sql(raw, D.re2(P.URL))
    out.append(f"SELECT k, CASE WHEN len(c) > 0 THEN {ORD_URL} ELSE {ORD_URL + 1} END AS ord, "
               f"'external_instruction_source' AS sid, CASE WHEN len(c) > 0 THEN {P.URL_CONTEXT_SEVERITY} "
               f"ELSE {P.BARE_URL_SEVERITY} END AS sev, m['start'] AS s, m['end'] AS e FROM "
               f"(SELECT k, c, unnest(CASE WHEN len(c) > 0 THEN c ELSE b END) AS m FROM "
               f"(SELECT k, {ctx} AS c, {bare} AS b FROM {src}))")
    out += encoded_rows(src, raw)
    return out


def encoded_rows(src="d", raw="raw") -> list[str]:
    b64 = oracle_spans_sql(raw, D.re2(P.BASE64_BLOB))
    hexb = oracle_spans_sql(raw, D.re2(P.HEX_BLOB))
    rot = oracle_spans_sql(wv(raw), D.re2(P.ROT13_HINT, "I"))
    toks = oracle_spans_sql(raw, D.re2(P.LONG_TOKEN))
    tok_text = f"substr({raw}, t['start'] + 1, t['end'] - t['start'])"
    hi = f"list_filter({toks}, lambda t: {OP.entropy(tok_text)} >= {P.ENTROPY_THRESHOLD})"
    return [_rows(ORD_ENC, "'encoded_payload'", P.ENCODED_SEVERITY, b64, src),
            _rows(ORD_ENC + 1, "'encoded_payload'", P.ENCODED_SEVERITY, hexb, src),
            _rows(ORD_ENC + 2, "'encoded_payload'", P.ENCODED_SEVERITY, rot, src),
            _rows(ORD_ENC + 3, "'encoded_payload'", P.ENCODED_SEVERITY, hi, src)]


def doc_signal_rows(src="d") -> list[str]:
    ev = OP.evasions("raw")
    total = f"({ev['homoglyph']} + {ev['zero_width']} + {ev['leet_mix']} + {ev['spaced_letters']})"
    note = (f"'homoglyphs=' || CAST({ev['homoglyph']} AS VARCHAR) || ',zero_width=' || CAST({ev['zero_width']} AS VARCHAR)"
            f" || ',leet=' || CAST({ev['leet_mix']} AS VARCHAR) || ',spaced=' || CAST({ev['spaced_letters']} AS VARCHAR)")
    sigs = {s[0]: s for s in OP.signal_exprs()}
    rows = [
        (0, "multi_stage_execution_chain", sigs["multi_stage_execution_chain"][1], "30", "'chained_imperatives'"),
        (1, "role_transition_spoofing", sigs["role_transition_spoofing"][1], "30", "'multiple_role_markers'"),
        (2, "semantic_contradiction", sigs["semantic_contradiction"][1], "25", "'contradictory_verb_pair'"),
        (3, "context_window_stuffing", sigs["context_window_stuffing"][1], "25", "'filler_then_payload'"),
        (4, "obfuscation_evasion", f"{total} >= 5", f"CASE WHEN {total} < 15 THEN 20 ELSE 30 END", note),
    ]
    return [f"SELECT k, {i} AS pos, '{cat}' AS category, CAST({w} AS INTEGER) AS weight, {n} AS note FROM {src} WHERE {c}"
            for i, cat, c, w, n in rows]


def decode_sql(seg: str) -> str:
    stripped = f"regexp_replace({seg}, {STRIP}, '', 'g')"
    compact = f"regexp_replace({stripped}, {q(WS + '+')}, '', 'g')"

    def b64(x):
        clean = f"regexp_replace({x}, '[^A-Za-z0-9+/=]', '', 'g')"
        return (f"CASE WHEN length({compact}) >= 8 AND length({compact}) % 4 = 0 AND "
                f"regexp_full_match({compact}, '[A-Za-z0-9+/=_-]+') AND length({clean}) % 4 = 0 AND "
                f"regexp_full_match({clean}, '[A-Za-z0-9+/]*={{0,2}}') THEN TRY(decode(from_base64({clean}))) END")
    v1 = b64(compact)
    v2 = b64(f"translate({compact}, '-_', '+/')")
    hx = (f"CASE WHEN length({compact}) >= 8 AND length({compact}) % 2 = 0 AND "
          f"regexp_full_match({compact}, '[0-9a-fA-F]+') THEN TRY(decode(unhex({compact}))) END")
    rot = (f"CASE WHEN translate({stripped}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', "
           f"'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') <> {stripped} THEN "
           f"translate({stripped}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', "
           f"'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') END")

    def ok(c):
        return (f"({c} IS NOT NULL AND {c} <> '' AND length(regexp_replace({c}, '[^\\x20-\\x7E\\t\\n\\r]', '', 'g'))"
                f" / length({c}) >= {P.PRINTABLE_RATIO_THRESHOLD})")
    return (f"CASE WHEN {ok(v1)} THEN {v1} WHEN {ok(v2)} THEN {v2} WHEN {ok(hx)} THEN {hx} "
            f"WHEN {ok(rot)} THEN {rot} END")


def decoded_level(frontier: str, view: str, depth: int) -> str:
    """CTEs {frontier}_n: rows of the frontier whose text trips a rule, with the numbers of findings and signals."""
    rows = "\nUNION ALL\n".join(f"SELECT k FROM ({r})" for r in signature_rows(view) + embedded_rows(view) + raw_rows(view))
    sigs = "\nUNION ALL\n".join(f"SELECT k FROM ({r})" for r in doc_signal_rows(view))
    return (f"{frontier}_f AS (SELECT k, count(*) AS n FROM ({rows}) GROUP BY k),\n"
            f"{frontier}_s AS (SELECT k, count(*) AS m FROM ({sigs}) GROUP BY k),\n"
            f"{frontier}_n AS (SELECT t.*, coalesce(f.n, 0) AS n_spans, coalesce(g.m, 0) AS n_signals FROM {frontier} t "
            f"LEFT JOIN {frontier}_f f ON f.k = t.dk LEFT JOIN {frontier}_s g ON g.k = t.dk)")


def note_sql(depth: int, n: str) -> str:
    return (f"'decoded_payload span=(' || CAST(ds AS VARCHAR) || ',' || CAST(de AS VARCHAR) || ') depth={depth} inner_signatures=' "
            f"|| CAST({n} AS VARCHAR) || ' inner_signals=' || CAST(n_signals AS VARCHAR)")


def chunk_ctes(src: str, key: str, text: str) -> str:
    """CTE ch: k, s, e, chunk of every sentence or line."""
    sep = oracle_spans_sql("raw", D.re2(r"[.!?]\s+|\n+"))
    return f"""ch0 AS (SELECT {key} AS k, {text} AS raw, list_transform({sep}, lambda x:
          {{'start': CASE WHEN regexp_matches(substr(raw, x['start'] + 1, 1), '[.!?]') THEN x['start'] + 1 ELSE x['start'] END,
            'end': x['end']}}) AS seps FROM {src}),
      ch1 AS (SELECT k, raw, unnest(list_transform(range(1, len(seps) + 2), lambda i: {{
          'start': CASE WHEN i = 1 THEN 0 ELSE seps[i - 1]['end'] END,
          'end': CASE WHEN i = len(seps) + 1 THEN length(raw) ELSE seps[i]['start'] END}})) AS c FROM ch0),
      ch AS (SELECT k, CAST(c['start'] AS BIGINT) AS s, CAST(c['end'] AS BIGINT) AS e,
                    substr(raw, c['start'] + 1, c['end'] - c['start']) AS chunk FROM ch1
             WHERE c['end'] > c['start'] AND regexp_replace(substr(raw, c['start'] + 1, c['end'] - c['start']), {STRIP}, '', 'g') <> '')"""


def similarity_ctes(src: str, key: str, text: str) -> str:
    """CTEs best (k, s, e, sim: best cosine of every chunk) and dsim (k, sim): distinct chunks, their grams exploded,
    joined with the templates' grams, products summed over both norms."""
    tpl = ", ".join(f"({i}, {q(t)})" for i, t in enumerate(P.CANONICAL_INJECTION_TEMPLATES))

    def grams(table: str, name: str) -> str:
        each = "\nUNION ALL\n".join(
            f"SELECT name, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n}))) AS g FROM {table}"
            for n in (3, 4, 5))
        return f"{name} AS (SELECT name, g, count(*) AS n FROM ({each}) GROUP BY name, g)"

    def padded(t: str) -> str:
        return f"' ' || regexp_replace(regexp_replace(lower({t}), {STRIP}, '', 'g'), {q(WS + '+')}, ' ', 'g') || ' '"
    return (chunk_ctes(src, key, text) + f""",
      tt AS (SELECT name, {padded('t')} AS t FROM (VALUES {tpl}) AS v(name, t)),
      ct AS (SELECT DISTINCT chunk AS name, {padded('chunk')} AS t FROM ch),
      {grams('tt', 'tg')}, {grams('ct', 'cg')},
      tn AS (SELECT name, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM tg GROUP BY name),
      cn AS (SELECT name, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM cg GROUP BY name),
      dots AS (SELECT cg.name AS c, tg.name AS t, sum(cg.n * tg.n) AS dot FROM cg JOIN tg ON cg.g = tg.g GROUP BY 1, 2),
      sims AS (SELECT c, max(dot / (cn.norm * tn.norm)) AS sim FROM dots JOIN cn ON cn.name = c JOIN tn ON tn.name = t GROUP BY c),
      best AS (SELECT ch.k, ch.s, ch.e, coalesce(sim, CAST(0 AS DOUBLE)) AS sim FROM ch LEFT JOIN sims ON sims.c = ch.chunk),
      dsim AS (SELECT k, max(sim) AS sim, count(*) FILTER (WHERE sim >= {P.SEMANTIC_SIMILARITY_THRESHOLD}) AS n_hits FROM best GROUP BY k)""")


def base_ctes(with_decoded=True, src: str = "seeded_docs", key: str = "doc_id", text: str = "text",
              similarity: bool = False, trusted: str = "false", trusted_ev: str = "NULL") -> str:
    pre = cte_prefix("seeded_docs").rstrip() + ",\n"
    pre += n5_ctes(src, key, text) + ",\n"
    enc_union = "\nUNION ALL\n".join(encoded_rows())
    pre += f"enc AS ({enc_union}),\n"
    pre += f"decs AS (SELECT e.k, e.ord, e.s, e.e, {decode_sql('substr(d.raw, e.s + 1, e.e - e.s)')} AS dtext "
    pre += "FROM enc e JOIN d ON d.k = e.k),\n"
    pre += ("dsrc AS (SELECT row_number() OVER (ORDER BY k, ord, s, e) AS dk, k AS up, ord AS dord, s AS ds, e AS de, dtext "
            "FROM decs WHERE dtext IS NOT NULL),\n")
    pre += n5_ctes("dsrc", "dk", "dtext", prefix="x") + ",\n"
    enc1 = "\nUNION ALL\n".join(encoded_rows("x"))
    pre += f"enc1 AS ({enc1}),\n"
    pre += f"decs1 AS (SELECT e.k, e.ord, e.s, e.e, {decode_sql('substr(x.raw, e.s + 1, e.e - e.s)')} AS dtext "
    pre += "FROM enc1 e JOIN x ON x.k = e.k),\n"
    pre += ("dsrc1 AS (SELECT row_number() OVER (ORDER BY k, ord, s, e) AS dk, k AS up, ord AS dord, s AS ds, e AS de, dtext "
            "FROM decs1 WHERE dtext IS NOT NULL),\n")
    pre += n5_ctes("dsrc1", "dk", "dtext", prefix="y") + ",\n"
    pre += decoded_level("dsrc1", "y", 2) + ",\n" + decoded_level("dsrc", "x", 1) + ",\n"
    pre += (f"hit2 AS (SELECT up, count(*) AS n_inner, string_agg({note_sql(2, 'n_spans')}, ' | ' ORDER BY dord, ds, de) AS inner_notes "
            "FROM dsrc1_n WHERE n_spans + n_signals > 0 GROUP BY up),\n"
            "hit1 AS (SELECT t.*, n_spans + coalesce(n_inner, 0) AS n_all, inner_notes FROM dsrc_n t LEFT JOIN hit2 h ON h.up = t.dk),\n"
            f"decoded AS (SELECT up AS k, dord, ds AS s, de AS e, {note_sql(1, 'n_all')} || coalesce(' | ' || inner_notes, '') AS note "
            "FROM hit1 WHERE n_all + n_signals > 0),\n"
            "dnotes AS (SELECT k, string_agg(note, ' | ' ORDER BY dord, s, e) AS notes FROM decoded GROUP BY k),\n")
    rows = signature_rows() + embedded_rows() + raw_rows()
    if similarity:
        pre += similarity_ctes(src, key, text) + ",\n"
        rows.append(f"SELECT k, {ORD_SEMANTIC} AS ord, 'semantic_injection' AS sid, CAST(round_even(30 + sim * 20, 0) AS INTEGER) AS sev, "
                    f"s, e FROM best WHERE sim >= {P.SEMANTIC_SIMILARITY_THRESHOLD}")
    else:
        pre += "dsim AS (SELECT k, CAST(0 AS DOUBLE) AS sim FROM d WHERE false),\n"
    rows.append(f"SELECT k, {ORD_DECODED} AS ord, 'decoded_payload_injection' AS sid, "
                f"least(50 + {P.ENCODED_SEVERITY}, 90) AS sev, s, e FROM decoded")
    pre += ("rawf AS (SELECT k, ord, sid, sev, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (\n"
            + "\nUNION ALL\n".join(rows) + "\n)),\n")
    pre += "sig AS (\n" + "\nUNION ALL\n".join(doc_signal_rows()) + "\n),\n"
    fences = oracle_spans_sql("raw", D.re2(P.CODE_FENCE, "S"))
    inline = oracle_spans_sql("raw", D.re2(P.INLINE_CODE))
    frame = rx(P.EXAMPLE_FRAMING, "I")
    pre += (f"ctxs AS (SELECT k, {fences} AS fences, {inline} AS inl FROM d),\n"
            f"damp AS (SELECT f.*, (coalesce(list_bool_or(list_transform(c.fences, lambda x: x['start'] <= f.s AND f.e <= x['end'])), false)"
            f" OR coalesce(list_bool_or(list_transform(c.inl, lambda x: x['start'] <= f.s AND f.e <= x['end'])), false)"
            f" OR regexp_matches({wv('substr(d.raw, greatest(f.s - 80, 0) + 1, f.s - greatest(f.s - 80, 0))')}, {frame}))"
            f" AS dampened FROM rawf f JOIN ctxs c ON c.k = f.k JOIN d ON d.k = f.k),\n")
    pre += """o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, ord) AS rn FROM damp),
g AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM o),
h AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY rn) AS island FROM g),
merged AS (SELECT k, island, min(s) AS s, max(e) AS e, first(sid ORDER BY sev DESC, rn) AS sid, max(sev) AS sev,
           bool_or(dampened) AS dampened FROM h GROUP BY k, island),
"""
    pre += f"""contrib AS (SELECT k, sid, max(CASE WHEN dampened THEN CAST(trunc(sev * CAST({P.DAMPENING_FACTOR} AS DOUBLE)) AS INTEGER)
           ELSE sev END) AS c FROM merged GROUP BY k, sid),
ss AS (SELECT k, sum(c) AS span_score FROM contrib GROUP BY k),
mstat AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE dampened) AS nd,
           bool_or(sid = 'external_instruction_source') AS ext, bool_or(sid = 'decoded_payload_injection') AS dec,
           string_agg('signature=' || sid || ' severity=' || CAST(sev AS VARCHAR) || ' span=(' || CAST(s AS VARCHAR) || ','
             || CAST(e AS VARCHAR) || ') dampened=' || CASE WHEN dampened THEN 'True' ELSE 'False' END, ' | ' ORDER BY s) AS mev
           FROM merged GROUP BY k),
sstat AS (SELECT k, sum(weight) AS doc_score, bool_or(category = 'role_transition_spoofing') AS role,
           string_agg('signal=' || category || ' weight=' || CAST(weight AS VARCHAR) || ' note=' || note, ' | ' ORDER BY pos) AS sev_ FROM sig GROUP BY k),
red AS (SELECT t.k, string_agg(substr(d.raw, t.cut + 1, t.s - t.cut) || {q(P.REDACTION_TOKEN)}, '' ORDER BY t.s)
           || substr(any_value(d.raw), max(t.e) + 1) AS sanitized_text
        FROM (SELECT *, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY s) AS cut FROM merged) t JOIN d ON d.k = t.k GROUP BY t.k),
"""
    ev = OP.evasions("d.raw")
    obf = f"({ev['homoglyph']} + {ev['zero_width']} + {ev['leet_mix']} + {ev['spaced_letters']})"
    verbs = OP.count("d.raw", OP.VERBS)
    toks = f"len({OP.words('d.raw')})"
    dens = f"(CASE WHEN {toks} > 0 THEN least({verbs} / {toks} * CAST(10 AS DOUBLE), CAST(1.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END)"
    W = dict(P.CONFIDENCE_WEIGHTS)
    wd = lambda n: f"CAST({W[n]} AS DOUBLE)"
    pre += f"""tr AS (SELECT {key} AS k, {trusted} AS trusted, {trusted_ev} AS tev FROM {src}),
conf0 AS (SELECT d.k, d.raw, coalesce(ss.span_score, 0) AS span_score, coalesce(sstat.doc_score, 0) AS doc_score,
        (mstat.k IS NOT NULL OR sstat.k IS NOT NULL) AS hit,
        ({wd('regex')} * least((coalesce(ss.span_score, 0) + coalesce(sstat.doc_score, 0)) / CAST(100.0 AS DOUBLE), CAST(1.0 AS DOUBLE))
         + {wd('semantic')} * coalesce(dsim.sim, CAST(0.0 AS DOUBLE))
         + {wd('role_spoofing')} * CASE WHEN coalesce(sstat.role, false) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
         + {wd('imperative_density')} * {dens}
         + {wd('obfuscation')} * least({obf} / CAST(15.0 AS DOUBLE), CAST(1.0 AS DOUBLE))
         + {wd('external_source')} * CASE WHEN coalesce(mstat.ext, false) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
         + {wd('decoded_payload')} * CASE WHEN coalesce(mstat.dec, false) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)
        * (CAST(1.0 AS DOUBLE) - CAST(0.5 AS DOUBLE) * CASE WHEN coalesce(mstat.n, 0) > 0 THEN mstat.nd / mstat.n ELSE CAST(0.0 AS DOUBLE) END)
        AS c_raw, coalesce(dsim.sim, CAST(0.0 AS DOUBLE)) AS sim, coalesce(tr.trusted, false) AS trusted, tr.tev,
        mstat.mev, sstat.sev_, dnotes.notes, red.sanitized_text
        FROM d LEFT JOIN ss ON ss.k = d.k LEFT JOIN mstat ON mstat.k = d.k LEFT JOIN sstat ON sstat.k = d.k
        LEFT JOIN red ON red.k = d.k LEFT JOIN dnotes ON dnotes.k = d.k LEFT JOIN dsim ON dsim.k = d.k
        LEFT JOIN tr ON tr.k = d.k),
conf1 AS (SELECT *, greatest(CAST(0.0 AS DOUBLE), least(c_raw, CAST(1.0 AS DOUBLE))) * CASE WHEN trusted
        THEN CAST({P.ALLOWLIST_DAMPENING_FACTOR} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS conf FROM conf0),
res AS (SELECT k, hit, conf, CASE WHEN conf >= {P.DOC_BLOCK_THRESHOLD} THEN 'block' WHEN conf >= {P.DOC_REVIEW_THRESHOLD}
        THEN 'review' ELSE 'allow' END AS decision, least(CAST(round_even(conf * 100, 0) AS INTEGER), 100) AS score0,
        sim, trusted, tev, mev, sev_, notes, coalesce(sanitized_text, raw) AS sanitized_text, span_score, doc_score FROM conf1)
"""
    return pre


def rag_sql() -> dict[str, str]:
    base = base_ctes()
    n5 = cte_prefix("seeded_docs").rstrip() + ",\n" + n5_ctes("seeded_docs", "doc_id", "text") + "\n"
    chunk = cte_prefix("seeded_docs").rstrip() + ",\n" + chunk_ctes("seeded_docs", "doc_id", "text") + (
        "\nSELECT k AS doc_id, s AS start_pos, e AS end_pos FROM ch")
    banner = oracle_spans_sql(wv("norm"), D.re2(P.RAG_SIGNATURES[20][2], P.RAG_SIGNATURES[20][3]))
    trusted_ids = ", ".join(q(x) for x in P.TRUSTED_DOCUMENT_IDS)
    nid = f"lower(regexp_replace(document_id, {STRIP}, '', 'g'))"
    trusted = (f"coalesce(document_id IS NOT NULL AND document_id <> '' AND ({nid} IN ({trusted_ids}) OR "
               + " OR ".join(f"contains({nid}, {q(s)})" for s in P.TRUSTED_ID_SUBSTRINGS) + "), false)")
    verbs = OP.count("text", OP.VERBS)
    toks = f"len({OP.words('text')})"
    evidence = ("array_to_string(list_filter([mev, sev_, notes, 'semantic_max_similarity=' || printf('%.3f', sim) || ' threshold=0.85', "
                "'confidence=' || printf('%.3f', conf) || ' decision=' || decision, CASE WHEN trusted THEN tev END], lambda x: x IS NOT NULL), ' | ')")
    allowed = "'allow_listed_source document_id=' || chr(39) || document_id || chr(39)"
    whole = f"""SELECT k AS doc_id, hit AND decision <> 'allow' AS matched,
            CAST(CASE WHEN NOT hit THEN 0 WHEN decision <> 'allow' AND score0 = 0 THEN 60 ELSE score0 END AS BIGINT) AS score,
            CASE WHEN hit THEN decision ELSE 'allow' END AS decision,
            round(CASE WHEN hit THEN conf ELSE 0.0 END, 6) AS confidence,
            CASE WHEN hit THEN {evidence} ELSE '' END AS evidence, sanitized_text FROM res"""
    return {
        "normalize_with_map": n5 + "SELECT k AS doc_id, norm, CAST(length(norm) AS BIGINT) AS norm_len FROM d",
        "map_span": n5 + f"SELECT k AS doc_id, CAST(m['start'] AS BIGINT) AS start_pos, CAST(m['end'] AS BIGINT) AS end_pos "
                         f"FROM (SELECT k, unnest({mapped(banner)}) AS m FROM d)",
        "chunk_text": chunk,
        "signature_spans": base + "SELECT k AS doc_id, sid AS signature_id, CAST(s AS BIGINT) AS start_pos, "
                                  "CAST(e AS BIGINT) AS end_pos FROM rawf WHERE ord < 1000",
        "embedded_spans": base + f"SELECT k AS doc_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos FROM rawf "
                                 f"WHERE ord >= {ORD_EMBEDDED} AND ord < {ORD_MULTI}",
        "multilingual_spans": base + f"SELECT k AS doc_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos "
                                     f"FROM rawf WHERE ord >= {ORD_MULTI} AND ord < {ORD_URL}",
        "url_spans": base + f"SELECT k AS doc_id, CAST(sev AS BIGINT) AS severity, CAST(s AS BIGINT) AS start_pos, "
                            f"CAST(e AS BIGINT) AS end_pos FROM rawf WHERE ord >= {ORD_URL} AND ord < {ORD_ENC}",
        "encoded_spans": base + "SELECT k AS doc_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos FROM enc",
        "doc_signals": base + "SELECT k AS doc_id, category, CAST(weight AS BIGINT) AS weight, note FROM sig",
        "documentation_dampening": base + "SELECT k AS doc_id, sid AS signature_id, CAST(s AS BIGINT) AS start_pos, "
                                          "CAST(e AS BIGINT) AS end_pos FROM damp WHERE dampened",
        "merge_findings": base + "SELECT k AS doc_id, sid AS signature_id, CAST(sev AS BIGINT) AS severity, "
                                 "CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, dampened FROM merged",
        "redact_instructions": base + "SELECT k AS doc_id, CASE WHEN hit THEN sanitized_text ELSE sanitized_text END "
                                      "AS sanitized_text FROM res",
        "rag_span_score": base + "SELECT k AS doc_id, CAST(span_score AS BIGINT) AS span_score, "
                                 "CAST(doc_score AS BIGINT) AS doc_score FROM res",
        "decode_payload": base + "SELECT k AS doc_id, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, "
                                 "dtext AS decoded FROM decs WHERE dtext IS NOT NULL",
        "decode_rescan": base + "SELECT k AS doc_id, CAST(least(50 + 20, 90) AS BIGINT) AS severity, CAST(s AS BIGINT) AS start_pos, "
                                "CAST(e AS BIGINT) AS end_pos FROM decoded",
        "decode_notes": base + "SELECT k AS doc_id, CAST(i AS BIGINT) AS ord, ns[i + 1] AS note FROM (SELECT k, ns, unnest(range(len(ns))) AS i "
                               "FROM (SELECT k, string_split(notes, ' | ') AS ns FROM dnotes))",
        "trusted_source": cte_prefix("seeded_docs") + f"SELECT doc_id, document_id, {trusted} AS trusted FROM seeded_docs",
        "imperative_density": cte_prefix("seeded_docs") + f"SELECT doc_id, round(CASE WHEN {toks} > 0 THEN "
                              f"least({verbs} / {toks} * CAST(10 AS DOUBLE), CAST(1.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END, 6) "
                              f"AS density FROM seeded_docs",
        "confidence": base + "SELECT k AS doc_id, round(CASE WHEN hit THEN conf ELSE 0.0 END, 6) AS confidence FROM res",
        "doc_decision": base + """SELECT k AS doc_id, CASE WHEN hit THEN decision ELSE 'allow' END AS decision,
            hit AND decision <> 'allow' AS matched,
            CAST(CASE WHEN NOT hit THEN 0 WHEN decision <> 'allow' AND score0 = 0 THEN 60 ELSE score0 END AS BIGINT) AS score
            FROM res""",
        "rag_rules": base + whole,
        "rag_similar": base_ctes(similarity=True) + whole,          # no query of its own: part of analyze_similarity
        "rag_scan": base_ctes(similarity=True, trusted=trusted, trusted_ev=allowed) + whole,
        "template_similarity": cte_prefix("seeded_docs").rstrip() + ",\n" + similarity_ctes("seeded_docs", "doc_id", "text")
                               + "\nSELECT d.doc_id, round(coalesce(sim, 0), 6) AS max_similarity, CAST(coalesce(n_hits, 0) AS BIGINT) AS n_hits "
                                 "FROM seeded_docs d LEFT JOIN dsim ON dsim.k = d.doc_id",
        "rag_decision_counts": base + """SELECT CASE WHEN hit THEN decision ELSE 'allow' END AS decision,
            count(*) AS n_docs, CAST(sum(CASE WHEN NOT hit THEN 0 WHEN decision <> 'allow' AND score0 = 0 THEN 60
            ELSE score0 END) AS BIGINT) AS sum_score FROM res GROUP BY 1""",
        "rag_blocked": base + """SELECT k AS doc_id, decision, sanitized_text FROM res
            WHERE hit AND decision <> 'allow'""",
        "page_rules": base_ctes(src="pages", key="page_id", text="html") + f"""SELECT k AS page_id,
            hit AND decision <> 'allow' AS matched,
            CAST(CASE WHEN NOT hit THEN 0 WHEN decision <> 'allow' AND score0 = 0 THEN 60 ELSE score0 END AS BIGINT) AS score,
            CASE WHEN hit THEN decision ELSE 'allow' END AS decision,
            round(CASE WHEN hit THEN conf ELSE 0.0 END, 6) AS confidence,
            CASE WHEN hit THEN {evidence} ELSE '' END AS evidence, sanitized_text FROM res""",
        "vector_similarity": """WITH t AS (SELECT vec_id AS tid, embedding AS tv FROM embeddings WHERE vec_id < 16),
            s AS (SELECT e.vec_id, t.tid, coalesce(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.tv AS DOUBLE[]))
                   / nullif(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
                   * sqrt(list_dot_product(CAST(t.tv AS DOUBLE[]), CAST(t.tv AS DOUBLE[]))), 0), 0) AS cos
                  FROM embeddings e, t)
            SELECT vec_id, round(max(cos), 6) AS best_similarity, arg_max(tid, cos * 1e9 - tid) AS best_template,
                   max(cos) >= 0.85 AS is_hit FROM s GROUP BY vec_id""",
    }
