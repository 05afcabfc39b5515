"""DuckDB SQL for the rows of the queries, where SQL can express them."""

from __future__ import annotations

from . import secrets, sharding, url_filters, vector_codes

#: Words as op2 and op8 take them.
SPACED = r"[^\x20\x09-\x0D]+"

#: The table of the checksum that documents are chosen by.
CRCS = "crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"

OP2 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{SPACED}') AS w FROM docs)),
base AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
symbols AS (SELECT doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM docs),
windows AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM words),
twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows WHERE len(w) = 8) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs)),
worded AS (SELECT *, regexp_extract_all(line, '{SPACED}') AS w FROM lines WHERE regexp_matches(line, '{SPACED}')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
judged AS (SELECT doc_id, k, len(w) AS n,
    (len(w) >= 3 AND NOT regexp_matches(w[-1], '[^\x00-\x20\x21-\x7F]$|[.!?:;"'')\]}}]$'))
    OR 5 * len(list_filter(w, lambda x: x = '|')) > len(w)
    OR (2 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > len(w) AND length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= 3)
    OR (len(w) >= 3 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^a-z]', '', 'g')))
    OR (len(w) >= 4 AND 2 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > len(w))
    OR (regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '^[\x09-\x0D\x20]*(all rights reserved|licensed under|released under|this work is licensed|copyright|terms of service|privacy policy|cookie policy|sign up for|subscribe to our newsletter)')) AS fails
  FROM worded),
lost AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE fails) AS n_lines_removed, coalesce(sum(n) FILTER (WHERE fails), 0) AS n_words_removed FROM judged GROUP BY doc_id),
every AS (SELECT docs.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(n_words_removed, 0)::BIGINT AS n_words_removed
  FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN symbols USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
    NOT failed AND 2 * n_words_removed <= n_words AS kept, n_lines, n_lines_removed, n_words_removed
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM every)
"""

OP8 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACED}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, least FROM reach JOIN ways ON a = reach.doc_id),
names AS (SELECT doc_id, min(least) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM names LEFT JOIN sizes USING (doc_id)
"""


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op3() -> str:
    """Rank along the curve: the axes are turned level by level, as in Skilling's transform."""
    n, bits, levels = 3, sharding.BITS, []
    x = [f"x{i}" for i in range(n)]

    def level(new: list[str]) -> None:
        """One more subquery that replaces the axes."""
        levels.append(", ".join(f"{e} AS x{i}" for i, e in enumerate(new)))

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            t = f"(xor(x0, x{i}) & {p})"
            on = f"(x{i} & {q}) <> 0"
            new = list(x)
            new[0] = f"CASE WHEN {on} THEN xor(x0, {p}) ELSE xor(x0, {t}) END"
            if i:
                new[i] = f"CASE WHEN {on} THEN x{i} ELSE xor(x{i}, {t}) END"
            level(new)
    for i in range(1, n):
        level([*x[:i], f"xor(x{i}, x{i - 1})", *x[i + 1 :]])
    turn = "0"
    for b in range(1, bits):
        turn = f"xor({turn}, CASE WHEN (x{n - 1} & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    level([f"xor({a}, {turn})" for a in x])
    query = "cells"
    for columns in levels:
        query = f"(SELECT doc_id, size, crc, {columns} FROM {query})"
    curve = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    code = lambda c: f"('0x' || rpad(substr(hex(encode({c})), 1, 14), 14, '0'))::BIGINT"
    scale = lambda c: f"coalesce((({c} - min({c}) OVER ()) // greatest(1, ((max({c}) OVER () - min({c}) OVER () + 1) + {(1 << bits) - 1}) // {1 << bits}))::BIGINT, 0)"
    return f"""
WITH {CRCS},
bytes AS (SELECT documents.*, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM documents),
numbers AS (SELECT doc_id, len(b) + 1 AS size, xor(list_reduce(list_concat([4294967295], b), lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1])), 4294967295) AS crc,
    {code("source")} AS a0, {code("lang")} AS a1, floor(log2(n_chars + 1) * 1024)::BIGINT AS a2 FROM bytes, crcs),
cells AS (SELECT doc_id, size, crc, {scale("a0")} AS x0, {scale("a1")} AS x1, {scale("a2")} AS x2 FROM numbers),
indexed AS (SELECT doc_id, size, crc, {curve} AS curve FROM {query}),
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, crc) - 1 AS r, count(*) OVER () AS n FROM indexed),
cut AS (SELECT *, n // 8 AS small, n % 8 AS more, (n % 8) * (n // 8 + 1) AS big FROM ranked),
dealt AS (SELECT *, CASE WHEN r < big THEN r // (small + 1) ELSE (r - big) // greatest(small, 1) + more END AS shard FROM cut)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
    (r - CASE WHEN shard < more THEN shard * (small + 1) ELSE big + (shard - more) * small END)::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve::BIGINT AS curve
FROM dealt"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def op4() -> str:
    """Spans from the text between matches; entropy of each window counted anew."""
    parts = []

    def located(name: str, pattern: str) -> None:
        parts.append(f"""{name}_m AS (SELECT doc_id, unnest(m) AS m, unnest(g[1:len(m)]) AS gap, unnest(range(len(m))) AS k
            FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS m, regexp_split_to_array(text, {_quoted(pattern)}) AS g FROM docs WHERE regexp_matches(text, {_quoted(pattern)}))),
        {name}_at AS (SELECT doc_id, k, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS pos FROM {name}_m)""")

    for rank, (kind, (pattern, group, least)) in enumerate(secrets.BASE.items()):
        located(kind, pattern)
        parts.append(f"{kind} AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, pos AS s, pos + length(m) AS e FROM {kind}_at WHERE length(regexp_extract(m, {_quoted(pattern)}, {group})) >= {least})")
    parts.append("base AS (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in secrets.BASE) + ")")
    for rank, (kind, (pattern, window, least)) in enumerate(secrets.ENTROPY.items(), len(secrets.BASE)):
        located(kind, pattern)
        known = "m"
        for placeholder, size in secrets.PLACEHOLDERS:
            known = f"regexp_replace({known}, {_quoted(placeholder)}, '{' ' * size}', 'g')"
        has = lambda of: f"length(regexp_replace(w, '[^{of}]', '', 'g'))"
        parts.append(f"""{kind}_w AS (SELECT doc_id, pos, i, substr(m, i + 1, {window}) AS w FROM (SELECT doc_id, pos, {known} AS m, unnest(range(length(m) - {window} + 1)) AS i FROM {kind}_at)
            WHERE NOT contains(w, ' ') AND {has("0-9")} >= 1 AND {has("A-Za-z")} >= 1 AND ({has("0-9")} >= 3 OR {has("A-Z")} >= 1 AND {has("a-z")} >= 1)),
        {kind}_n AS (SELECT doc_id, pos, i, c, count(*) AS n FROM (SELECT doc_id, pos, i, unnest(string_split(w, '')) AS c FROM {kind}_w) GROUP BY ALL),
        {kind}_h AS (SELECT doc_id, pos, i FROM {kind}_n GROUP BY ALL HAVING sum(-n / {window}::DOUBLE * log2(n / {window}::DOUBLE)) >= {least}),
        {kind}_s AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, pos + min(i) AS s, pos + max(i) + {window} AS e FROM {kind}_h GROUP BY doc_id, pos),
        {kind} AS (SELECT x.* FROM {kind}_s x ANTI JOIN base b ON b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)""")
    parts.append("every AS (SELECT * FROM base UNION ALL " + " UNION ALL ".join(f"SELECT * FROM {k}" for k in secrets.ENTROPY) + ")")
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)},
counts AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE)}, {listed} AS list FROM base GROUP BY doc_id),
lists AS (SELECT doc_id, {listed} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(list, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN counts USING (doc_id) LEFT JOIN lists USING (doc_id)"""


def op5() -> str:
    """The same rounds of propagation, one after the other."""
    u = url_filters
    lower = lambda x: f"translate({x}, '{u.UPPER}', '{u.LOWER}')"
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'"
        for v, h, p in sorted(u.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    parts = []
    for name, verdict, x, y in (("trust", "allow", "x", "y"), ("distrust", "block", "y", "x")):
        parts.append(f"""{name}_seed AS MATERIALIZED (SELECT host, n_{verdict} / (SELECT sum(n_{verdict}) FROM hosts)::DOUBLE AS weight FROM hosts WHERE n_{verdict} > 0),
        {name}_step AS MATERIALIZED (SELECT {x} AS a, {y} AS b, n / (sum(n) OVER (PARTITION BY {x}))::DOUBLE AS share FROM links),
        {name}_0 AS (SELECT host, weight AS rank FROM {name}_seed)""")
        for k in range(u.ROUNDS):
            parts.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT host, round(sum(rank), {u.DECIMALS}) AS rank FROM (
                SELECT b AS host, {u.FOLLOW} * rank * share AS rank FROM {name}_step JOIN {name}_{k} ON a = host
                UNION ALL SELECT host, (1 - {u.FOLLOW}) * weight FROM {name}_seed) GROUP BY host)""")
    return f"""
WITH rows AS MATERIALIZED (SELECT page_id, html, coalesce({lower("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, CASE {fits} END AS fit FROM rows),
hosts AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE fit LIKE 'allow %') AS n_allow, count(*) FILTER (WHERE fit LIKE 'block %') AS n_block FROM ruled WHERE host <> '' GROUP BY host),
links AS MATERIALIZED (SELECT x, y, count(*) AS n FROM (SELECT host AS x, {lower("unnest(regexp_extract_all(html, " + _quoted(u.LINK) + ", 1))")} AS y FROM rows) WHERE x <> '' AND y <> '' AND x <> y GROUP BY ALL),
{", ".join(parts)},
doubts AS (SELECT host, CASE WHEN coalesce(t.rank, 0) + coalesce(d.rank, 0) > 0 THEN coalesce(d.rank, 0) / (coalesce(t.rank, 0) + coalesce(d.rank, 0)) ELSE 0 END AS doubt
    FROM hosts LEFT JOIN trust_{u.ROUNDS} t USING (host) LEFT JOIN distrust_{u.ROUNDS} d USING (host))
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, coalesce(split_part(fit, ' ', 1), CASE WHEN coalesce(doubt, 0) > {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(doubt, 0), 6) AS doubt
FROM ruled LEFT JOIN doubts USING (host)"""


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, list_slice(w, k, k + least(len(w), 10) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, k, n, item_id FROM places JOIN windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Pairs of equal six words in a text; stretches of them, one after the other, are what agrees a period apart.
OP11 = rf"""
WITH {CRCS},
chosen AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1])), 4294967295) AS h FROM documents, crcs),
places AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM chosen),
texts AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM places),
words AS MATERIALIZED (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM texts),
sixes AS MATERIALIZED (SELECT doc_id, i, hash(list_slice(w, i + 1, i + 6)) AS h, list_slice(w, i + 1, i + 6) AS six FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 5, 0))) AS i FROM texts)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM sixes x JOIN sixes y ON x.doc_id = y.doc_id AND x.h = y.h AND x.i < y.i WHERE x.six = y.six),
stretches AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 6 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM pairs) GROUP BY doc_id, q, part),
runs AS MATERIALIZED (SELECT doc_id, s, length, min(q) AS q FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lists AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS list, max({{'l': length, 's': -s, 'q': -q}}) AS best FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.s)::BIGINT AS start, best.l::BIGINT AS length, (-best.q)::BIGINT AS period, (1000 * best.l // -best.q)::BIGINT AS exponent_milli,
    sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256, len(w)::BIGINT AS n_words
FROM texts LEFT JOIN lists USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

OP12 = """
WITH rows AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
valid AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM rows
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.r AS s, c.vec_id,
    list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.norm * c.norm) AS score
  FROM valid q JOIN valid c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, s) AS rank FROM scored) WHERE rank <= 5
"""


def op13() -> str:
    """Rounds of assigning and moving, one after the other, by all distances."""
    c = vector_codes
    nearest = lambda books: f"(SELECT r, part, arg_min({{'d': d, 'entry': entry}}, {{'d': d, 'entry': entry}}) AS best FROM (SELECT p.r, p.part, e.entry, list_sum(list_transform(list_zip(p.v, e.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM parts p JOIN {books} e USING (part)) GROUP BY ALL)"
    rounds = [f"books_0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM parts WHERE r <= {c.ENTRIES})"]
    for k in range(c.ROUNDS):
        rounds.append(f"""given_{k} AS MATERIALIZED {nearest(f"books_{k}")},
        means_{k} AS (SELECT part, entry, list(mean ORDER BY pos) AS v FROM (SELECT part, g.best.entry AS entry, pos, floor(sum(p.v[pos]) / count(*))::BIGINT AS mean
            FROM given_{k} g JOIN parts p USING (r, part), unnest(range(1, len(p.v) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL),
        books_{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books_{k} b LEFT JOIN means_{k} m USING (part, entry))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({c.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, part, list_slice(v, part * w + 1, (part + 1) * w) AS v FROM (SELECT r, v, len(v) // {c.PARTS} AS w, unnest(range({c.PARTS})) AS part FROM kept)),
{", ".join(rounds)},
last AS (SELECT r, string_agg(lower(lpad(to_hex(best.entry), 2, '0')), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM {nearest(f"books_{c.ROUNDS}")} GROUP BY r),
numbers AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books_{c.ROUNDS})
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN last USING (r), numbers"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2, "op3_hilbert_sharding": op3(), "op4_secret_scans": op4(), "op5_url_filters": op5(),
    "op7_decontaminate": OP7, "op8_minhash": OP8, "op11_periodic_runs": OP11, "op12_neighbours": OP12, "op13_vector_codes": op13(),
}
