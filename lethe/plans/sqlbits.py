"""SQL fragments shared by the DuckDB oracle strings."""

from lethe.functions.text import PY_WHITESPACE

WS = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def extract_response(t: str) -> str:
    return (f"CASE WHEN contains({t}, 'ASSISTANT:') THEN {strip(f'split_part({t}, {chr(39)}ASSISTANT:{chr(39)}, 2)')} "
            f"WHEN contains({t}, 'Answer:') THEN {strip(f'split_part({t}, {chr(39)}Answer:{chr(39)}, 2)')} "
            f"ELSE {strip(t)} END")


def option_letter(r: str, opts: str) -> str:
    first = f"upper(substr({r}, 1, 1))"
    return f"CASE WHEN length({r}) > 0 AND map_contains({opts}, {first}) THEN {first} END"


def py_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def rouge_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def grams(tokens: str, n: int) -> str:
    """list of n-grams (space-joined) of a token list."""
    return (f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n} + 2), "
            f"lambda i: array_to_string(list_slice({tokens}, i, i + {n} - 1), ' ')) ELSE [] END")


def split_cte(name: str, ids_view: str, ratios, seed: int = 42) -> str:
    """E3 in SQL: rank by md5(seed:p:id), first floor(p/100*n) forget; every
    row counts (a null id hashes without its part)."""
    vals = ", ".join(str(int(r)) for r in ratios)
    return f"""{name} AS (
  SELECT id, ratio, CASE WHEN rn <= k THEN 'forget' ELSE 'retain' END AS "set" FROM (
    SELECT i.id, i.ratio,
           row_number() OVER (PARTITION BY i.ratio
             ORDER BY md5('{seed}:' || CAST(i.ratio AS VARCHAR) || coalesce(':' || i.id, '')), i.id) AS rn,
           CAST(floor(CAST(i.ratio AS DOUBLE) / 100.0 * count(*) OVER (PARTITION BY i.ratio)) AS BIGINT) AS k
    FROM (SELECT id, CAST(unnest([{vals}]) AS INTEGER) AS ratio FROM {ids_view}) i) s)"""


def lit(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def show(x: str) -> str:
    """Python's f-string rendering of an optional string."""
    return f"coalesce(CAST({x} AS VARCHAR), 'None')"


def options_text(opts: str) -> str:
    return (f"array_to_string(list_transform(map_entries({opts}), "
            f"lambda e: e.key || ': ' || coalesce(e.value, 'None')), chr(10))")


def mcq_prompt(q: str, opts: str, llama: bool = False) -> str:
    sep = lit("\n####Choices:\n") if llama else "chr(10)"
    return f"{show(q)} || {sep} || {options_text(opts)}"


def few_shot_item(q: str, opts: str, ans: str, kind: str, llama: bool = False) -> str:
    if llama:
        head = f"CASE WHEN {kind} = 'Image_Textual' THEN {lit(chr(10).join(['<|image|>', '<|begin_of_text|>']))} ELSE '<|begin_of_text|>' END || '### Question: '"
    else:
        head = f"CASE WHEN {kind} = 'Image_Textual' THEN {lit('USER: <image>' + chr(10))} ELSE {lit('USER:' + chr(10))} END || 'Question: '"
    body = f"{head} || {show(q)} || chr(10)"
    if llama:
        body += " || 'Options:' || chr(10)"
    for k in "ABCD":
        body += f" || '{k}: ' || {show(f'{opts}[{chr(39)}{k}{chr(39)}]')} || chr(10)"
    return body + f" || 'Correct Answer: ' || {show(ans)} || chr(10)"


def text_scores_ctes(src: str, key: str, ref: str, hyp: str, stem: bool = False) -> str:
    """CTEs ``tok``, ``grams``, ``pg``, ``ov``, ``piv``, ``scores``: BLEU-4
    (whitespace tokens, method-1 smoothing) and ROUGE-1/2 F (no stemming)
    per ``key`` of ``src``."""
    parts = []
    for tag, (r, h), ns in (("b", ("bref", "bhyp"), range(1, 5)), ("r", ("rref", "rhyp"), range(1, 3))):
        for n in ns:
            parts.append(f"SELECT {key}, '{tag}' AS m, {n} AS n, unnest({grams(r, n)}) AS g, 0 AS side FROM tok")
            parts.append(f"SELECT {key}, '{tag}', {n}, unnest({grams(h, n)}), 1 FROM tok")
    cols = []
    for tag, ns in (("b", range(1, 5)), ("r", range(1, 3))):
        for n in ns:
            for c in ("num", "hyp", "ref"):
                cols.append(f"sum({c}) FILTER (WHERE m = '{tag}' AND n = {n}) AS {tag}{n}_{c}")

    def z(c):
        return f"coalesce({c}, 0)"
    logs = " + ".join(
        f"ln((CASE WHEN {z(f'b{n}_num')} = 0 THEN 0.1 ELSE {z(f'b{n}_num')} END) / greatest({z(f'b{n}_hyp')}, 1)) / 4"
        for n in range(1, 5))
    bp = (f"CASE WHEN {z('b1_hyp')} > {z('b1_ref')} THEN 1.0 "
          f"ELSE exp(1 - CAST({z('b1_ref')} AS DOUBLE) / {z('b1_hyp')}) END")
    bleu = f"CASE WHEN {z('b1_num')} = 0 THEN 0.0 ELSE ({bp}) * exp({logs}) END"

    def rouge(n):
        p = f"(CAST({z(f'r{n}_num')} AS DOUBLE) / greatest({z(f'r{n}_hyp')}, 1))"
        r = f"(CAST({z(f'r{n}_num')} AS DOUBLE) / greatest({z(f'r{n}_ref')}, 1))"
        return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
    union = "\n  UNION ALL ".join(parts)
    if stem:
        stem_sql, rs_name = porter_ctes("rd", "t", "rs")
        # Stemming a scalar per unnested token (a stemmer nested inside a
        # list lambda makes DuckDB's binder blow up), then lists again.
        pre = f"""rt0 AS (SELECT {key}, {rouge_tokens(ref)} AS r0, {rouge_tokens(hyp)} AS h0 FROM {src}),
ru AS (SELECT {key}, 0 AS side, unnest(r0) AS t, generate_subscripts(r0, 1) AS p FROM rt0
       UNION ALL SELECT {key}, 1, unnest(h0), generate_subscripts(h0, 1) FROM rt0),
rd AS MATERIALIZED (SELECT DISTINCT t FROM ru),
{stem_sql},
rl AS (SELECT u.{key}, coalesce(list(s.s ORDER BY u.p) FILTER (WHERE u.side = 0), []) AS rref,
              coalesce(list(s.s ORDER BY u.p) FILTER (WHERE u.side = 1), []) AS rhyp
       FROM ru u JOIN rs s ON s.t = u.t GROUP BY u.{key}),
"""
        rsel = f"coalesce(rl.rref, []) AS rref, coalesce(rl.rhyp, []) AS rhyp"
        src_join = f"{src} LEFT JOIN rl USING ({key})"
    else:
        pre = ""
        rsel = f"{rouge_tokens(ref)} AS rref, {rouge_tokens(hyp)} AS rhyp"
        src_join = src
    return pre + f"""tok AS MATERIALIZED (SELECT {key}, {py_split(ref)} AS bref, {py_split(hyp)} AS bhyp,
                      {rsel} FROM {src_join}),
grams AS ({union}),
pg AS (SELECT {key}, m, n, g, sum(1 - side) AS rc, sum(side) AS hc FROM grams GROUP BY {key}, m, n, g),
ov AS (SELECT {key}, m, n, sum(least(rc, hc)) AS num, sum(hc) AS hyp, sum(rc) AS ref FROM pg GROUP BY {key}, m, n),
piv AS (SELECT {key}, {', '.join(cols)} FROM ov GROUP BY {key}),
scores AS (SELECT {key}, {bleu} AS bleu, {rouge(1)} AS rouge1, {rouge(2)} AS rouge2 FROM piv)"""


def lcs_len(r: str, h: str) -> str:
    """LCS length of two token lists: the dynamic-programming table row by
    row (outer fold over ``h``), each row built left to right."""
    return (f"list_reduce({h}, lambda old, x: list_reduce(range(1, len({r}) + 1), "
            f"lambda acc, j: list_append(acc, CASE WHEN {r}[j] = x THEN old[j] + 1 "
            f"ELSE greatest(acc[-1], old[j + 1]) END), [0]), "
            f"list_transform(range(0, len({r}) + 1), lambda i: 0))[-1]")


# ----------------------------------------------------------------------------
# Porter stemmer in DuckDB SQL (oracle of X12).  Each step is one
# materialised CTE: the word and its consonant/vowel string are columns,
# suffixes are tested longest first.

def _cv(w: str) -> str:
    """'c'/'v' per letter; y is a vowel after a consonant."""
    return (f"list_reduce(range(1, length({w}) + 1), lambda acc, i: acc || CASE "
            f"WHEN substr({w}, i, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'v' "
            f"WHEN substr({w}, i, 1) = 'y' THEN (CASE WHEN i = 1 OR right(acc, 1) = 'v' THEN 'c' ELSE 'v' END) "
            f"ELSE 'c' END, '')")


def _m(cv: str, n: str) -> str:
    """Measure of the first ``n`` letters."""
    return f"((length(substr({cv}, 1, {n})) - length(replace(substr({cv}, 1, {n}), 'vc', ''))) // 2)"


def _has_v(cv: str, n: str) -> str:
    return f"contains(substr({cv}, 1, {n}), 'v')"


def _dbl(w: str, cv: str, n: str) -> str:
    return f"({n} >= 2 AND substr({w}, {n}, 1) = substr({w}, {n} - 1, 1) AND substr({cv}, {n}, 1) = 'c')"


def _cvc(w: str, cv: str, n: str) -> str:
    return (f"(({n} >= 3 AND substr({cv}, {n} - 2, 3) = 'cvc' AND substr({w}, {n}, 1) NOT IN ('w', 'x', 'y')) "
            f"OR ({n} = 2 AND substr({cv}, 1, 2) = 'vc'))")


def _suffix_rules(w: str, cv: str, rules, cond) -> str:
    parts = []
    for suf, rep in sorted(rules, key=lambda r: -len(r[0])):
        n = f"(length({w}) - {len(suf)})"
        parts.append(f"WHEN suffix({w}, '{suf}') THEN (CASE WHEN {cond(n, suf)} "
                     f"THEN left({w}, {n}) || '{rep}' ELSE {w} END)")
    return "CASE " + " ".join(parts) + f" ELSE {w} END"


# The suffixes of steps 2 to 4 and the irregular words of the
# extended stemmer, written for the oracle from the published description.
_ORACLE_STEP2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("bli", "ble"), ("eli", "e"),
]
_ORACLE_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""),
                 ("ful", "")]
_ORACLE_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous",
                 "ive", "ize", "al", "er", "ic", "ou"]
_ORACLE_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning",
    "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def porter_ctes(src: str, col: str, out: str = "stem_out") -> tuple[str, str]:
    """The extended Porter stemmer over column ``col`` of CTE ``src`` as a
    chain of materialised CTEs, one per step (the word and its
    consonant/vowel string become columns).  Returns ``(ctes, name)``; CTE
    ``name`` has ``col`` and ``s`` (tokens of three letters or fewer
    unchanged, the ROUGE rule)."""
    s1a = ("CASE WHEN suffix(w0, 'ies') THEN left(w0, length(w0) - CASE WHEN length(w0) = 4 THEN 1 ELSE 2 END) "
           "WHEN suffix(w0, 'sses') THEN left(w0, length(w0) - 2) "
           "WHEN suffix(w0, 'ss') THEN w0 WHEN suffix(w0, 's') THEN left(w0, length(w0) - 1) ELSE w0 END")
    cut_ed = f"suffix(w1, 'ed') AND {_has_v('c1', 'length(w1) - 2')}"
    cut_ing = f"suffix(w1, 'ing') AND {_has_v('c1', 'length(w1) - 3')}"
    s1b_w = (f"CASE WHEN suffix(w1, 'ied') THEN left(w1, length(w1) - CASE WHEN length(w1) = 4 THEN 1 ELSE 2 END) "
             f"WHEN suffix(w1, 'eed') THEN (CASE WHEN {_m('c1', 'length(w1) - 3')} > 0 "
             f"THEN left(w1, length(w1) - 1) ELSE w1 END) "
             f"WHEN {cut_ed} THEN left(w1, length(w1) - 2) WHEN {cut_ing} THEN left(w1, length(w1) - 3) ELSE w1 END")
    s1b_x = f"(NOT suffix(w1, 'eed') AND NOT suffix(w1, 'ied') AND (({cut_ed}) OR ({cut_ing})))"
    fix = (f"CASE WHEN NOT bx THEN bw "
           f"WHEN suffix(bw, 'at') OR suffix(bw, 'bl') OR suffix(bw, 'iz') THEN bw || 'e' "
           f"WHEN {_dbl('bw', 'cb', 'length(bw)')} THEN CASE WHEN right(bw, 1) IN ('l', 's', 'z') THEN bw "
           f"ELSE left(bw, length(bw) - 1) END "
           f"WHEN {_m('cb', 'length(bw)')} = 1 AND {_cvc('bw', 'cb', 'length(bw)')} THEN bw || 'e' "
           f"ELSE bw END")
    s1c = ("CASE WHEN suffix(w2, 'y') AND length(w2) > 2 AND substr(c2, length(w2) - 1, 1) = 'c' "
           "THEN left(w2, length(w2) - 1) || 'i' ELSE w2 END")
    # alli, where it may go, is al first and then looked at again.
    s2a = (f"CASE WHEN suffix(w3, 'alli') AND {_m('c3', 'length(w3) - 4')} > 0 THEN left(w3, length(w3) - 2) "
           f"ELSE w3 END")
    s2 = ("CASE WHEN suffix(w3b, 'logi') THEN (CASE WHEN " + _m("c3b", "(length(w3b) - 3)")
          + " > 0 THEN left(w3b, length(w3b) - 1) ELSE w3b END) ELSE "
          + _suffix_rules("w3b", "c3b", _ORACLE_STEP2, lambda n, s: f"{_m('c3b', n)} > 0") + " END")
    s3 = _suffix_rules("w4", "c4", _ORACLE_STEP3, lambda n, s: f"{_m('c4', n)} > 0")
    s4 = _suffix_rules("w5", "c5", [(x, "") for x in _ORACLE_STEP4],
                       lambda n, s: f"{_m('c5', n)} > 1" + (
                           f" AND substr(w5, {n}, 1) IN ('s', 't')" if s == "ion" else ""))
    s5a = (f"CASE WHEN suffix(w6, 'e') AND ({_m('c6', 'length(w6) - 1')} > 1 OR "
           f"({_m('c6', 'length(w6) - 1')} = 1 AND NOT {_cvc('w6', 'c6', '(length(w6) - 1)')})) "
           f"THEN left(w6, length(w6) - 1) ELSE w6 END")
    s5b = (f"CASE WHEN suffix(w7, 'll') AND {_m('c7', '(length(w7) - 1)')} > 1 "
           f"THEN left(w7, length(w7) - 1) ELSE w7 END")
    steps = [
        f"{col} AS w0", f"{s1a} AS w1", f"{_cv('w1')} AS c1", f"{s1b_w} AS bw, {s1b_x} AS bx", f"{_cv('bw')} AS cb",
        f"{fix} AS w2", f"{_cv('w2')} AS c2", f"{s1c} AS w3", f"{_cv('w3')} AS c3", f"{s2a} AS w3b",
        f"{_cv('w3b')} AS c3b", f"{s2} AS w4", f"{_cv('w4')} AS c4", f"{s3} AS w5", f"{_cv('w5')} AS c5",
        f"{s4} AS w6", f"{_cv('w6')} AS c6", f"{s5a} AS w7", f"{_cv('w7')} AS c7",
    ]
    ctes, prev = [], src
    for k, expr in enumerate(steps):
        name = f"{out}_{k}"
        keep = f"{col}" if k == 0 else "*"
        ctes.append(f"{name} AS MATERIALIZED (SELECT {keep}, {expr} FROM {prev})")
        prev = name
    irregular = " ".join(f"WHEN w0 = '{w}' THEN '{t}'" for w, t in _ORACLE_IRREGULAR.items())
    ctes.append(f"{out} AS MATERIALIZED (SELECT {col}, CASE WHEN length({col}) <= 3 THEN {col} {irregular} "
                f"ELSE {s5b} END AS s FROM {prev})")
    return ",\n".join(ctes), out
