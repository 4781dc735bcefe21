"""DuckDB SQL for the rows of those queries that SQL can express; plain definitions, meant for small tables.

`r` numbers the rows of `documents`, so that repeated ids stay apart.
"""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(pattern: str, text: str = "text") -> str:
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


def windows(source: str, keys: str, n: str) -> str:
    """Each run of n consecutive words of the lists w of a source, with its place p."""
    return f"(SELECT {keys}, p, {n} AS n, array_to_string(w[p:p + {n} - 1], ' ') AS gram FROM (SELECT {keys}, w, unnest(generate_series(1, len(w) - {n} + 1)) AS p FROM {source}))"


NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {words(SPACED, LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(gram) AS h FROM (SELECT doc_id, gram FROM {windows('d', 'doc_id', '5')} UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT doc_id, doc_id AS root FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON c.doc_id = e.a),
m AS (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

PASSAGES = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words(SPACED)} AS w FROM documents),
g AS MATERIALIZED (SELECT r, p, md5_number(gram) AS h FROM {windows('d', 'r', '35')}),
x AS (SELECT DISTINCT r, p + unnest(range(35)) AS i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
u AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS rest FROM u ANTI JOIN x USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

CONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words(ALNUM, LOWER)} AS w FROM documents), q AS (SELECT item_id, {words(ALNUM, LOWER)} AS w FROM benchmark),
i AS MATERIALIZED (SELECT DISTINCT item_id, n, gram FROM (SELECT item_id, n, gram FROM {windows('q', 'item_id', '13')} UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM q WHERE len(w) BETWEEN 1 AND 12)),
z AS (SELECT DISTINCT n AS size FROM i), s AS (SELECT r, w, size FROM d, z WHERE len(w) >= size),
m AS MATERIALIZED (SELECT r, p, v.n, item_id FROM {windows('s', 'r, size', 'size')} v JOIN i USING (n, gram)),
h AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, p + unnest(range(n)) AS i FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

# Bytes as pairs of hexadecimal digits; texts are cut into stretches of 512 starts, so that no long string is read for each place.
BYTES = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS h FROM documents),
c AS (SELECT r, n, k, substr(h, 1024 * k + 1, 1122) AS part FROM (SELECT *, unnest(range(0, (n + 511) // 512)) AS k FROM d)),
g AS MATERIALIZED (SELECT r, 512 * k + o AS p, md5_number(substr(part, 2 * o + 1, 100)) AS s FROM (SELECT *, unnest(range(0, greatest(least(512, n - 49 - 512 * k), 0))) AS o FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM g JOIN d USING (r) GROUP BY s HAVING count(*) > 1),
x AS (SELECT r, p FROM g JOIN d USING (r) JOIN f USING (s) WHERE first < doc_id),
b AS (SELECT r, p, coalesce(p > lag(p) OVER o + 50, true) AS fresh FROM x WINDOW o AS (PARTITION BY r ORDER BY p)),
i AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM b),
e AS (SELECT r, run, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY r, run),
k AS (SELECT e.*, h, n, lag(z, 1, 0) OVER o AS before, lead(a) OVER o IS NULL AS last FROM e JOIN d USING (r) WINDOW o AS (PARTITION BY r ORDER BY run)),
t AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY run) AS rest FROM k GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)"""

# Lines of equal token sets are one set; sets that are similar enough share one of their rarest tokens.
LINES = f"""WITH l AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text <> '')),
t AS MATERIALIZED (SELECT id, doc_id, place, list_sort(list_distinct({words(SPACED, LOWER.replace('text', 'line'))})) AS w FROM l),
s AS MATERIALIZED (SELECT row_number() OVER () AS k, w, len(w) AS n, min((doc_id, place)) AS first FROM t WHERE len(w) > 0 GROUP BY w),
u AS MATERIALIZED (SELECT k, n, first, unnest(w) AS word FROM s), df AS (SELECT word, count(*) AS df FROM u GROUP BY word),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY df, word) AS i FROM u JOIN df USING (word) QUALIFY i <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.word = b.word AND a.k <> b.k AND a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (SELECT b, min(x.first) AS earlier FROM (SELECT a, b FROM c) JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w))) GROUP BY b),
g AS (SELECT id FROM t JOIN s USING (w) LEFT JOIN v ON v.b = s.k WHERE s.first < (doc_id, place) OR v.earlier < (doc_id, place)),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.id IS NOT NULL) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (g.id IS NULL) AS rest FROM l LEFT JOIN g ON l.id = g.id GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""

# DuckDB has no CRC-32: its table of 256 entries follows from the polynomial, and a string's bytes are pairs of hexadecimal digits.
CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS crc FROM range(256) AS x(i)"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8 bytes; `crc` is the table."""
    of_bytes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {of_bytes}), lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1])), 4294967295)"


# Words at distance one differ in one place or by one letter, so their fronts up to it and their rests behind it agree.
SPELLINGS = f"""WITH RECURSIVE z AS MATERIALIZED ({CRC_TABLE}),
r AS MATERIALIZED (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS MATERIALIZED (SELECT run, n, {crc32("(doc_id || ':' || run)")} AS h FROM q, z),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word AS word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
k AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-v.n, near)) AS near, max(v.n) AS most FROM p JOIN v ON v.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN near END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n FROM v LEFT JOIN k USING (word)),
w AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
e AS (SELECT w.word, w.root FROM w JOIN f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)"""

RESAMPLED = f"""WITH z AS MATERIALIZED ({CRC_TABLE}), d AS MATERIALIZED (SELECT doc_id, {words(ALNUM, LOWER)} AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d), y AS (SELECT unnest({words(ALNUM, LOWER)}) AS word FROM benchmark),
b AS MATERIALIZED (SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y), z),
s AS (SELECT bucket, count(*) AS s FROM x JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM y JOIN b USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS s_all, (SELECT count(*) FROM y)::DOUBLE AS t_all),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
m AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM x JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM c LEFT JOIN o USING (doc_id)"""

ORACLES = {
    "op2_minhash_near_dedup": NEAR,
    "op3_substring_dedup": PASSAGES,
    "op5_decontamination": CONTAMINATION,
    "op7_suffix_array_dedup": BYTES,
    "op10_line_dedup": LINES,
    "op11_spelling_variants": SPELLINGS,
    "op12_importance_resampling": RESAMPLED,
}
