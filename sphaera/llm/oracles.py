"""SQL for the text queries that SQL can express, run by DuckDB over the same tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Every window of 100 bytes by its digest; a window with an earlier equal one opens a run of removed bytes.
REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
k AS (SELECT doc_id, s, sha256(b[s+1:s+100]) AS g FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS s FROM d WHERE octet_length(b) >= 100)),
f AS (SELECT g, min(doc_id * 1000000000 + s) AS first FROM k GROUP BY g HAVING count(*) > 1),
r AS (SELECT k.doc_id, k.s, lag(k.s) OVER w AS before, lead(k.s) OVER w AS after FROM k JOIN f USING (g) WHERE k.doc_id * 1000000000 + k.s > f.first WINDOW w AS (PARTITION BY k.doc_id ORDER BY k.s)),
edge AS (SELECT doc_id, s, CASE WHEN before IS NULL OR before + 100 < s THEN s END AS opens, CASE WHEN after IS NULL OR s + 100 < after THEN s + 100 END AS closes FROM r),
span AS (SELECT o.doc_id, o.opens AS lo, min(c.closes) AS hi FROM edge o JOIN edge c ON c.doc_id = o.doc_id AND c.closes > o.opens WHERE o.opens IS NOT NULL AND c.closes IS NOT NULL GROUP BY 1, 2),
gap AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM span UNION ALL SELECT d.doc_id, coalesce(m.hi, 0), octet_length(d.b) FROM d LEFT JOIN (SELECT doc_id, max(hi) AS hi FROM span GROUP BY 1) m ON m.doc_id = d.doc_id),
kept AS (SELECT gap.doc_id, sha256(unhex(string_agg(CASE WHEN gap.hi > gap.lo THEN hex(d.b[gap.lo+1:gap.hi]) ELSE '' END, '' ORDER BY gap.lo, gap.hi))) AS kept_sha256 FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY 1),
t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, kept.kept_sha256 FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

#: All pairs that share a shingle, their exact similarity, and reachability.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k:k+3], ' ')) WHEN len(ws) > 0 THEN [chr(1) || array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
sym AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(id, lab) AS (SELECT x, x FROM sym UNION SELECT s.y, r.lab FROM reach r JOIN sym s ON s.x = r.id WHERE r.lab < s.y),
c AS (SELECT id, min(lab) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

#: Every phrase by its words, its parts by the same table, sums in 128 bits.
PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) AS phrase FROM w, range(1, 4) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND c >= 10),
cut AS (SELECT c.lang, c.k, c.phrase, c.a, c.ws, j, array_to_string(c.ws[1:j], ' ') AS one, array_to_string(c.ws[j+1:], ' ') AS two FROM c, range(1, 3) t(j) WHERE j < c.k),
s AS (SELECT cut.*, x.c AS l, y.c AS r, ((1000000::HUGEINT * cut.a * cut.a) // (x.c::HUGEINT * y.c))::BIGINT AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.one AND x.k = j JOIN f y ON y.lang = cut.lang AND y.phrase = cut.two AND y.k = cut.k - j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(ws[i:i+1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) t(i) WHERE k = 3 GROUP BY 1, 2),
kept AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE b.k = 3 OR o.longer IS NULL OR 100 * o.longer < 50 * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score FROM kept JOIN n ON n.lang = kept.lang QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

ORACLE_SQL = {"op11_phrase_mining": PHRASES, "op7_suffix_array_dedup": REPEATS, "op10_minhash_near_dedup": NEAR_DUPLICATES}
