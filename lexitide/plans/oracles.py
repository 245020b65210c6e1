"""The same queries as DuckDB SQL over the supplied tables."""

from __future__ import annotations

DOCS = r"""docs AS (
  SELECT doc_id, lang AS domain, doc_id % 8 AS batch,
         CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(1900 + (doc_id * 37) % 120 AS INTEGER) END AS rights_year,
         regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS full_text
  FROM documents)"""
LABELLED = """labelled AS (
  SELECT doc_id, full_text, CAST(CAST(floor(rights_year / 10.0) * 10 AS INTEGER) AS VARCHAR) || 's' AS label
  FROM docs WHERE rights_year IS NOT NULL AND len(full_text) > 0)"""
SPLIT = """ranked AS (
  SELECT doc_id, full_text, label, count(*) OVER (PARTITION BY label) AS n,
         row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', doc_id)), doc_id) AS place FROM labelled),
split AS (
  SELECT doc_id, full_text, label,
         CASE WHEN place <= greatest(1, floor(n * CAST(0.2 AS DOUBLE))) THEN 'valid' ELSE 'train' END AS split
  FROM ranked WHERE n >= 50)"""
ASSIGNED = """assigned AS (
  SELECT vec_id AS doc_id, CAST(CASE WHEN label = 0 THEN -1 ELSE label - 1 END AS INTEGER) AS topic,
         CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST(1900 + (vec_id * 37) % 120 AS INTEGER) END AS rights_year, embedding
  FROM embeddings)"""


def _ctfidf(source: str, cls: str) -> str:
    return f"""counts AS (SELECT {cls}, term, count(*) AS tf FROM (SELECT {cls}, unnest(full_text) AS term FROM {source}) GROUP BY ALL),
totals AS (SELECT {cls}, sum(tf) AS words FROM counts GROUP BY ALL),
alltf AS (SELECT term, sum(tf) AS tf_all FROM counts GROUP BY ALL),
weights AS (SELECT {cls}, term, tf, round(CAST(tf AS DOUBLE) / words * ln(1 + (SELECT avg(words) FROM totals) / tf_all), 6) AS weight
  FROM counts JOIN totals USING ({cls}) JOIN alltf USING (term)),
words AS (SELECT {cls}, term, weight, CAST(row_number() OVER (PARTITION BY {cls} ORDER BY weight DESC, term) AS INTEGER) AS rank
  FROM weights QUALIFY rank <= 10)"""


TOPIC_DOCS = "topic_docs AS (SELECT topic, full_text FROM docs JOIN assigned USING (doc_id))"
TOPIC_WORDS = f"{DOCS}, {ASSIGNED}, {TOPIC_DOCS}, {_ctfidf('topic_docs', 'topic')}"
HARD = f"""{ASSIGNED},
years AS (SELECT rights_year, count(*) AS total FROM assigned WHERE rights_year IS NOT NULL GROUP BY ALL),
names AS (SELECT DISTINCT topic FROM assigned WHERE topic >= 0 AND rights_year IS NOT NULL),
hits AS (SELECT rights_year, topic, count(*) AS n FROM assigned WHERE rights_year IS NOT NULL GROUP BY ALL),
hard AS (SELECT rights_year, topic, CAST(coalesce(n, 0) AS DOUBLE) / total AS prevalence
  FROM years CROSS JOIN names LEFT JOIN hits USING (rights_year, topic))"""
STATS = """stats AS (
  SELECT topic, avg(prevalence) AS mean_prevalence, min(rights_year) AS first_year, max(rights_year) AS last_year,
         min(rights_year) FILTER (WHERE prevalence > 0) AS first_active_year,
         max(rights_year) FILTER (WHERE prevalence > 0) AS last_active_year FROM hard GROUP BY topic),
peaks AS (SELECT topic, rights_year AS peak_year FROM hard
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY prevalence DESC, rights_year) = 1)"""
SOFT = f"""{ASSIGNED},
long AS (SELECT doc_id, topic, rights_year, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM assigned),
centre AS (SELECT topic, i, avg(x) AS c FROM long WHERE topic >= 0 GROUP BY ALL),
clen AS (SELECT topic, sqrt(sum(c * c)) AS l FROM centre GROUP BY ALL),
vlen AS (SELECT doc_id, any_value(rights_year) AS rights_year, sqrt(sum(x * x)) AS l FROM long GROUP BY ALL),
dots AS (SELECT doc_id, centre.topic, sum(x * c) AS d FROM long JOIN centre USING (i) GROUP BY ALL),
e AS (SELECT doc_id, rights_year, dots.topic, exp(d / (vlen.l * clen.l)) AS e FROM dots JOIN vlen USING (doc_id) JOIN clen ON clen.topic = dots.topic),
soft AS (SELECT doc_id, rights_year, topic, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM e)"""


def _windows(window: int, stride: int) -> str:
    return f"""starts AS (SELECT doc_id, full_text, len(full_text) AS n, unnest(range(0, len(full_text), {stride})) AS s FROM docs),
windows AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS win_no, full_text[s + 1 : s + {window}] AS tokens
  FROM starts WHERE s = 0 OR s - {stride} + {window} < n)"""


def _tfidf(max_features: int, bigrams: bool) -> str:
    grams = "SELECT doc_id, split, unnest(full_text) AS term FROM split"
    if bigrams:
        grams += """ UNION ALL SELECT doc_id, split, concat(full_text[i], ' ', full_text[i + 1])
          FROM (SELECT doc_id, split, full_text, unnest(range(1, len(full_text))) AS i FROM split)"""
    return f"""WITH {DOCS}, {LABELLED}, {SPLIT},
grams AS ({grams}),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM grams GROUP BY ALL),
features AS (SELECT term, sum(tf) AS tf_all, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term HAVING count(*) >= 2
  ORDER BY tf_all DESC, term LIMIT {max_features}),
raw AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM split WHERE split = 'train')) / (1.0 + df)) + 1.0) AS w FROM tf JOIN features USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


INFORMATION = f"""WITH {DOCS},
t AS (SELECT doc_id, rights_year, unnest(range(len(full_text))) AS pos, unnest(full_text) AS term FROM docs),
v AS (SELECT term FROM (SELECT term, count(*) AS tf FROM t GROUP BY term HAVING count(*) >= 3 ORDER BY tf DESC, term LIMIT 30000)),
k AS (SELECT doc_id, pos, term, CAST(floor(rights_year / 10.0) * 10 AS INTEGER) AS decade FROM t JOIN v USING (term) WHERE rights_year IS NOT NULL),
c AS (SELECT a.decade, a.term, b.term AS context, count(*) AS n FROM k a JOIN (SELECT doc_id, term, pos, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS gap FROM k) b
  ON a.doc_id = b.doc_id AND a.pos = b.pos + b.gap GROUP BY ALL),
p AS (SELECT decade, term, n, sum(n) OVER (PARTITION BY decade, term) AS nt, sum(n) OVER (PARTITION BY decade, context) AS nx, sum(n) OVER (PARTITION BY decade) AS na FROM c),
l AS (SELECT DISTINCT decade, term FROM p WHERE ln(n * CAST(na AS DOUBLE) / (nt * nx)) > 0)"""


REPEATED_IDS = f"""WITH {DOCS}, {LABELLED}, {SPLIT},
rows_twice AS (
  SELECT s.doc_id, s.split, p.part, CASE WHEN p.part = 0 THEN s.full_text ELSE regexp_extract_all(lower(substr(d.text, 1, 200)), '[\\p{{L}}\\p{{N}}_]{{2,}}') END AS full_text
  FROM split s JOIN documents d USING (doc_id) CROSS JOIN (SELECT unnest([0, 1]) AS part) p),
tf AS (SELECT doc_id, part, split, term, count(*) AS tf FROM (SELECT doc_id, part, split, unnest(full_text) AS term FROM rows_twice) GROUP BY ALL),
features AS (SELECT term, sum(tf) AS tf_all, count(*) AS df FROM tf WHERE split = 'train' GROUP BY term HAVING count(*) >= 2
  ORDER BY tf_all DESC, term LIMIT 100000),
raw AS (SELECT doc_id, part, term, tf * (ln((1.0 + (SELECT count(*) FROM rows_twice WHERE split = 'train')) / (1.0 + df)) + 1.0) AS w FROM tf JOIN features USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, part)) AS weight FROM raw)
SELECT doc_id, term, count(*) AS n_rows, round(max(weight), 6) AS high, round(min(weight), 6) AS low FROM weights GROUP BY doc_id, term"""


VOTES = """pairs AS (
  SELECT a.vec_id AS doc_id, b.vec_id AS nbr, b.label,
         round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY dist, nbr) AS INTEGER) AS rank FROM pairs)"""

KMETRICS = """ks AS (SELECT unnest(range(2, 11)) AS k),
folded AS (SELECT CAST(k AS INTEGER) AS k, vec_id, label % k AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings CROSS JOIN ks),
long AS (SELECT k, cluster, unnest(range(64)) AS i, unnest(v) AS x FROM folded),
dims AS (SELECT k, cluster, i, count(*) * var_pop(x) AS ss FROM long GROUP BY ALL),
inert AS (SELECT k, sum(ss) AS inertia FROM dims GROUP BY k),
dist AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a CROSS JOIN embeddings b),
cs AS (SELECT x.k, x.vec_id, x.cluster AS own, y.cluster, sum(d) AS total, count(*) AS n
  FROM folded x JOIN dist ON dist.a = x.vec_id JOIN folded y ON y.vec_id = dist.b AND y.k = x.k GROUP BY ALL),
ab AS (SELECT k, vec_id, max(n) FILTER (WHERE own = cluster) AS size, max(total) FILTER (WHERE own = cluster) AS inside,
  min(total / n) FILTER (WHERE own <> cluster) AS b FROM cs GROUP BY ALL),
s AS (SELECT k, CASE WHEN size = 1 THEN 0 ELSE (b - inside / (size - 1)) / greatest(b, inside / (size - 1)) END AS s FROM ab),
sil AS (SELECT k, avg(s) AS silhouette FROM s GROUP BY k),
km AS (SELECT k, inertia, silhouette FROM inert JOIN sil USING (k))"""

ELBOW = """ends AS (SELECT min(k) AS x1, max(k) AS x2, arg_min(inertia, k) AS y1, arg_max(inertia, k) AS y2, count(*) AS n FROM {m}),
elbow AS (SELECT k AS k_elbow FROM {m}, ends
  ORDER BY abs((y2 - y1) * k - (x2 - x1) * inertia + x2 * y1 - y2 * x1) / sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2) DESC, k LIMIT 1)"""

TREE_LEVELS = """WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
core AS (SELECT a, max(d) AS core FROM (SELECT a, d FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5) GROUP BY a),
mr AS (SELECT p.a, p.b, greatest(p.d, x.core, y.core) AS w FROM pairs p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b),
levels AS (SELECT CAST(unnest([1.0, 1.15, 1.18, 1.2, 1.22, 1.25, 1.3]) AS DOUBLE) AS level),
edges AS (SELECT level, a, b FROM mr JOIN levels ON w <= level),
reach AS (SELECT level, vec_id AS a, vec_id AS b FROM levels, embeddings
  UNION SELECT r.level, r.a, e.b FROM reach r JOIN edges e ON e.level = r.level AND e.a = r.b),
parts AS (SELECT level, count(DISTINCT low) AS n FROM (SELECT level, a, min(b) AS low FROM reach GROUP BY ALL) GROUP BY level)
SELECT level, (SELECT count(*) FROM embeddings) - n AS n_edges, (SELECT count(*) - 1 FROM embeddings) AS n_tree FROM parts"""

METRIC_CELLS = """p AS (SELECT CAST(quality AS VARCHAR) AS y_true, CAST(toxic AS VARCHAR) AS y_pred FROM labels),
names AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p),
scores AS (SELECT label,
    (SELECT count(*) FROM p WHERE y_true = label AND y_pred = label) AS hits,
    (SELECT count(*) FROM p WHERE y_true = label) AS support,
    (SELECT count(*) FROM p WHERE y_pred = label) AS predicted FROM names),
rates AS (SELECT label, support, hits,
    CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall,
    2 * hits / CAST(predicted + support AS DOUBLE) AS f1 FROM scores)"""


def _class_given_word(prior: str, alpha: float, min_freq: int) -> str:
    return f"""WITH {DOCS},
n AS (SELECT domain AS label, term, count(*) AS n FROM (SELECT domain, unnest(full_text) AS term FROM docs) GROUP BY ALL),
words AS (SELECT term FROM n GROUP BY term HAVING sum(n) >= {min_freq}),
classes AS (SELECT label, sum(n) AS total, {prior} AS prior FROM n GROUP BY label),
j AS (SELECT term, label, (coalesce(n, 0) + {alpha}) / (total + {alpha} * (SELECT count(*) FROM words)) * prior AS j
  FROM words CROSS JOIN classes LEFT JOIN n USING (term, label))
SELECT term, label, round(j / sum(j) OVER (PARTITION BY term), 6) AS p FROM j"""


def _terms(text: str) -> str:
    return rf"unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}'))"


def _hash_embed() -> str:
    return f"""{_windows(256, 200)},
t AS (SELECT doc_id, win_no, len(tokens) AS n, unnest(tokens) AS t FROM windows),
h AS (SELECT doc_id, win_no, n, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM t),
w AS (SELECT doc_id, win_no, h % 64 AS dim, sum(CASE WHEN (h // 64) % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE -1 END) / any_value(n) AS s FROM h GROUP BY doc_id, win_no, h % 64),
cnt AS (SELECT doc_id, count(*) AS nw FROM windows GROUP BY doc_id),
d AS (SELECT doc_id, dim, sum(s) AS s FROM w GROUP BY ALL),
grid AS (SELECT doc_id, nw, unnest(range(64)) AS dim FROM cnt),
embedded AS (SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(coalesce(s, 0) / nw + 1e-9, 6) AS x FROM grid LEFT JOIN d USING (doc_id, dim))"""


# Facts of fitted models: what their output must be like, from the tables alone.
def _predicted(labelled: str, order: str) -> str:
    return f"""{labelled}, {SPLIT}
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(*) AS n_true, count(*) AS n_known, {order} FROM split WHERE split = 'valid'"""


DOMAINS = f"""WITH {DOCS}, labelled AS (SELECT doc_id, full_text, domain AS label FROM docs WHERE domain IS NOT NULL AND len(full_text) > 0)"""
QUADRANTS = """WITH labelled AS (SELECT vec_id AS doc_id, NULL AS full_text,
  CASE WHEN embedding[1] > 0 THEN '+' ELSE '-' END || CASE WHEN embedding[2] > 0 THEN '+' ELSE '-' END AS label FROM embeddings)"""


def _clustered(ks: str, more: str = "") -> str:
    return f"""SELECT k, count(*) AS n_rows, count(DISTINCT vec_id) AS n_docs, count(*) AS n_nearest, CAST(k AS BIGINT) AS n_clusters, true AS inertia_close{more}
FROM embeddings CROSS JOIN (SELECT CAST(unnest([{ks}]) AS INTEGER) AS k) GROUP BY k"""


ORACLES: dict[str, str] = {
    "doc_projection": f"WITH {DOCS} SELECT doc_id, rights_year, domain, CAST(len(full_text) AS INTEGER) AS n_tokens, md5(array_to_string(full_text, ' ')) AS text_md5 FROM docs WHERE len(full_text) > 0",
    "doc_filter_counts": f"WITH {DOCS} SELECT count(*) FILTER (WHERE len(full_text) > 0) AS processed, count(*) FILTER (WHERE len(full_text) = 0) AS skipped FROM docs",
    "batch_rollup": f"WITH {DOCS} SELECT batch, count(*) FILTER (WHERE len(full_text) > 0) AS processed, count(*) FILTER (WHERE len(full_text) = 0) AS skipped FROM docs GROUP BY ROLLUP (batch)",
    "decade_counts": f"WITH {DOCS}, {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "label_source_domain": f"WITH {DOCS} SELECT domain AS label, count(*) AS n FROM docs WHERE domain IS NOT NULL AND len(full_text) > 0 GROUP BY domain",
    "label_join": f"WITH {DOCS} SELECT doc_id, rights_year, 'q' || quality AS label FROM docs JOIN labels USING (doc_id) WHERE len(full_text) > 0",
    "label_ids": f"WITH {DOCS}, {LABELLED} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT label FROM labelled)",
    "frequent_classes": f"WITH {DOCS}, {LABELLED} SELECT label, doc_id FROM labelled QUALIFY count(*) OVER (PARTITION BY label) >= 78",
    "strat_split": f"WITH {DOCS}, {LABELLED}, {SPLIT} SELECT doc_id, label, split FROM split",
    "split_manifest": f"WITH {DOCS}, {LABELLED}, {SPLIT} SELECT count(*) AS n_docs, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'valid') AS n_valid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(50 AS INTEGER) AS min_docs, CAST(0.2 AS DOUBLE) AS val_ratio, CAST(42 AS INTEGER) AS seed FROM split",
    "file_limit": f"WITH {DOCS} SELECT batch, doc_id FROM docs WHERE len(full_text) > 0 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY doc_id) <= 20",
    "corpus_limit": f"WITH {DOCS} SELECT doc_id, rights_year FROM docs WHERE len(full_text) > 0 ORDER BY doc_id LIMIT 300",
    "doc_text_for_ids": f"WITH {DOCS} SELECT e.vec_id * 3 AS doc_id, docs.doc_id IS NOT NULL AS found, md5(coalesce(array_to_string(full_text, ' '), '')) AS text_md5 FROM embeddings e LEFT JOIN docs ON docs.doc_id = e.vec_id * 3",
    "token_windows": f"WITH {DOCS}, {_windows(256, 200)} SELECT doc_id, win_no, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS text_md5 FROM windows",
    "window_counts": f"WITH {DOCS}, {_windows(128, 100)} SELECT doc_id, count(*) AS n_windows FROM windows GROUP BY doc_id",
    "rep_parse": "SELECT doc_id, lang || '|' || source AS words FROM documents",
    "term_freq": f"SELECT term, count(*) AS tf FROM (SELECT {_terms('text')} AS term FROM documents) GROUP BY term",
    "corpus_union": f"SELECT term, count(*) AS tf FROM (SELECT {_terms('text')} AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) GROUP BY term",
    "normalised_terms": "SELECT term, count(*) AS tf FROM (SELECT "
    + _terms("translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')")
    + " AS term FROM documents) WHERE term NOT IN ('the', 'of', 'and', 'de', 'la', 'der', 'die') GROUP BY term",
    "vocab_topk": f"WITH c AS (SELECT term, count(*) AS tf FROM (SELECT {_terms('text')} AS term FROM documents) GROUP BY term) SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS term_idx, tf FROM c WHERE tf >= 3 ORDER BY tf DESC, term LIMIT 30000",
    "vocab_sketch": f"WITH c AS (SELECT term, count(*) AS tf FROM (SELECT {_terms('text')} AS term FROM documents) GROUP BY term) SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS term_idx, tf FROM c WHERE tf >= 3 ORDER BY tf DESC, term LIMIT 30000",
    "bigram_features_sketch": f"""WITH {DOCS}, {LABELLED}, {SPLIT},
grams AS (SELECT doc_id, unnest(full_text) AS term FROM split WHERE split = 'train' UNION ALL SELECT doc_id, concat(full_text[i], ' ', full_text[i + 1])
  FROM (SELECT doc_id, full_text, unnest(range(1, len(full_text))) AS i FROM split WHERE split = 'train')),
f AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS n FROM grams GROUP BY ALL) GROUP BY term HAVING count(*) >= 2
  ORDER BY tf DESC, term LIMIT 2000)
SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS term_idx, tf, df,
  round(ln((1.0 + (SELECT count(*) FROM split WHERE split = 'train')) / (1.0 + df)) + 1.0, 6) AS idf FROM f""",
    "tree_levels": TREE_LEVELS,
    "neighbor_graph": "SELECT count(*) * 10 AS n_rows, count(*) * 10 AS n_pairs, CAST(0 AS BIGINT) AS n_self, count(*) * 10 AS n_exact, true AS recalled FROM embeddings",
    "spectral_coordinates": "SELECT CAST(i AS INTEGER) AS i, true AS unit, true AS settled, true AS bounded FROM (SELECT unnest(range(4)) AS i)",
    "count_vectors": f"""WITH t AS (SELECT doc_id, {_terms('text')} AS term FROM documents),
c AS (SELECT term, count(*) AS tf FROM t GROUP BY term HAVING count(*) >= 3 ORDER BY tf DESC, term LIMIT 30000),
v AS (SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS term_idx FROM c)
SELECT doc_id, term_idx, count(*) AS tf FROM t JOIN v USING (term) GROUP BY ALL""",
    "tfidf_unigram": _tfidf(100_000, False),
    "tfidf_bigram": _tfidf(100_000, True),
    "tfidf_repeated_ids": REPEATED_IDS,
    "ctfidf_decade": f"WITH {DOCS}, {LABELLED}, {_ctfidf('labelled', 'label')} SELECT label, rank, term, weight FROM words",
    "ctfidf_role": r"WITH turns AS (SELECT role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS full_text FROM conversations), "
    + _ctfidf("turns", "role")
    + " SELECT role, rank, term, weight FROM words",
    "topic_words": f"WITH {TOPIC_WORDS} SELECT topic, rank, term, weight FROM words",
    "gloss_words": f"WITH {TOPIC_WORDS} SELECT topic, string_agg(term, ', ' ORDER BY rank) AS top_words FROM words WHERE rank <= 8 GROUP BY topic",
    "topic_info": f"""WITH {TOPIC_WORDS}, sizes AS (SELECT topic, count(*) AS doc_count FROM assigned GROUP BY topic)
SELECT topic, any_value(doc_count) AS doc_count, topic || '_' || string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name,
  string_agg(term, ' ' ORDER BY rank) AS words FROM sizes JOIN words USING (topic) GROUP BY topic""",
    "topic_numbers": f"""WITH {ASSIGNED}, sizes AS (SELECT topic, count(*) AS doc_count FROM assigned GROUP BY topic)
SELECT topic, CASE WHEN topic < 0 THEN -1 ELSE CAST(row_number() OVER (ORDER BY topic < 0, doc_count DESC, topic) - 1 AS INTEGER) END AS new_topic, doc_count FROM sizes""",
    "timeline_hard": f"WITH {HARD} SELECT rights_year, topic, round(prevalence, 6) AS prevalence FROM hard",
    "timeline_wide": f"WITH {HARD} SELECT rights_year, "
    + ", ".join(f"round(max(prevalence) FILTER (WHERE topic = {t}), 6) AS t{t}" for t in range(9))
    + " FROM hard GROUP BY rights_year",
    "timeline_unpivot": f"WITH {HARD} SELECT rights_year, topic, round(prevalence, 6) AS prevalence FROM hard",
    "timeline_stats": f"WITH {HARD}, {STATS} SELECT topic, round(mean_prevalence + 1e-9, 6) AS mean_prevalence, peak_year, first_year, last_year, first_active_year, last_active_year FROM stats JOIN peaks USING (topic)",
    "gloss_left_join": f"""WITH {TOPIC_WORDS}, {HARD.replace(ASSIGNED + ',', '')}, {STATS},
sizes AS (SELECT topic, count(*) AS doc_count FROM assigned GROUP BY topic),
info AS (SELECT topic, any_value(doc_count) AS doc_count, topic || '_' || string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS topic_name,
  string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank <= 8) AS top_words FROM sizes JOIN words USING (topic) GROUP BY topic)
SELECT topic AS topic_id, doc_count, topic_name, top_words, round(mean_prevalence + 1e-9, 6) AS mean_prevalence, peak_year, first_year, last_year
FROM info LEFT JOIN (SELECT * FROM stats JOIN peaks USING (topic)) USING (topic)""",
    "lda_gloss_join": f"""WITH {TOPIC_WORDS}, {HARD.replace(ASSIGNED + ',', '')}, {STATS},
g AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS top_words FROM words WHERE rank <= 5 AND topic >= 0 GROUP BY topic)
SELECT topic AS topic_id, top_words, round(mean_prevalence + 1e-9, 6) AS mean_prevalence, peak_year, first_year, last_year
FROM g LEFT JOIN (SELECT * FROM stats JOIN peaks USING (topic)) USING (topic)""",
    "timeline_soft": f"WITH {SOFT} SELECT rights_year, topic, round(avg(p), 6) AS prevalence FROM soft WHERE rights_year IS NOT NULL GROUP BY rights_year, topic",
    "argmax_topic": f"WITH {SOFT} SELECT doc_id, topic AS top_topic FROM soft QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, topic) = 1",
    "reform_shift": f"""WITH {HARD}, r AS (SELECT * FROM (VALUES ('first', 1933), ('second', 1964), ('third', 1996)) AS t(reform, reform_year)),
s AS (SELECT reform, topic, avg(prevalence) FILTER (WHERE rights_year < reform_year) AS before, avg(prevalence) FILTER (WHERE rights_year >= reform_year) AS after
  FROM hard JOIN r ON rights_year BETWEEN reform_year - 10 AND reform_year + 9 GROUP BY ALL)
SELECT reform, topic, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS shift FROM s""",
    "store_check": "SELECT vec_id % 8 AS batch, count(*) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dim, CAST(max(len(embedding)) AS INTEGER) AS max_dim, count(*) FILTER (WHERE vec_id IS NULL OR embedding IS NULL) AS n_incomplete FROM embeddings GROUP BY ALL",
    "embedding_mean": "WITH l AS (SELECT vec_id // 4 AS doc_id, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS x FROM l GROUP BY ALL",
    "hash_embed_docs": f"WITH {DOCS}, {_hash_embed()} SELECT doc_id, dim, x FROM embedded",
    "embed_repeated_ids": f"""WITH {DOCS.replace('docs AS', 'given AS')},
docs AS (SELECT doc_id * 16 + batch AS doc_id, full_text FROM given UNION ALL SELECT doc_id * 16 + batch + 8, full_text[1:10] FROM given), {_hash_embed()}
SELECT doc_id // 16 AS doc_id, doc_id % 16 AS batch, dim, x FROM embedded""",
    "knn_probe": f"WITH {VOTES} SELECT doc_id, nbr, rank, round(dist, 6) AS dist FROM near WHERE rank <= 5",
    "knn_exact": f"WITH {VOTES} SELECT doc_id, nbr, rank, round(dist, 6) AS dist FROM near WHERE rank <= 5",
    "knn_euclidean": """WITH l AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS c FROM l GROUP BY ALL),
d AS (SELECT vec_id AS doc_id, CAST(c.label AS BIGINT) AS nbr, round(sqrt(sum((x - c) * (x - c))), 9) AS dist FROM l JOIN c USING (i) GROUP BY vec_id, c.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY dist, nbr) AS INTEGER) AS rank FROM d)
SELECT doc_id, nbr, rank, round(dist, 6) AS dist FROM r WHERE rank <= 3""",
    "knn_vote": f"""WITH {VOTES}, v AS (SELECT doc_id, label, count(*) AS votes, min(rank) AS nearest FROM near WHERE rank <= 15 GROUP BY ALL)
SELECT doc_id, label AS y_pred, votes FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, nearest) = 1""",
    "inertia_given": "WITH l AS (SELECT label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), d AS (SELECT count(*) * var_pop(x) AS ss FROM l GROUP BY label, i) SELECT round(sum(ss), 4) AS inertia FROM d",
    "silhouette_given": """WITH e AS (SELECT vec_id, CAST(label AS INTEGER) AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cs AS (SELECT a.vec_id, a.cluster AS own, b.cluster, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM e a CROSS JOIN e b GROUP BY ALL),
ab AS (SELECT vec_id, own, max(n) FILTER (WHERE own = cluster) AS size, max(total) FILTER (WHERE own = cluster) AS inside, min(total / n) FILTER (WHERE own <> cluster) AS b FROM cs GROUP BY ALL),
s AS (SELECT own, CASE WHEN size = 1 THEN 0 ELSE (b - inside / (size - 1)) / greatest(b, inside / (size - 1)) END AS s FROM ab)
SELECT own AS cluster, count(*) AS n, round(avg(s), 6) AS silhouette FROM s GROUP BY own""",
    "step_sample_text": "WITH k AS (SELECT md5(CAST(vec_id AS VARCHAR)) AS key FROM embeddings), r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM k) "
    "SELECT key FROM r WHERE n <= 300 OR i % greatest(1, n // 120) = 0",
    "file_limit_text": f"WITH {DOCS}, k AS (SELECT batch, doc_id, md5(CAST(doc_id AS VARCHAR)) AS key FROM docs WHERE len(full_text) > 0) "
    "SELECT batch, doc_id, key FROM k QUALIFY row_number() OVER (PARTITION BY batch ORDER BY key) <= 1100",
    "step_sample": "WITH r AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT doc_id FROM r WHERE n <= 300 OR i % greatest(1, n // 120) = 0",
    "k_metrics": f"WITH {KMETRICS} SELECT k, round(inertia, 4) AS inertia, round(silhouette, 6) AS silhouette FROM km",
    "k_recommend": f"""WITH {KMETRICS}, {ELBOW.format(m='km')}, best AS (SELECT k AS k_best_silhouette FROM km ORDER BY silhouette DESC, k LIMIT 1)
SELECT n AS n_candidates, k_elbow, k_best_silhouette, CAST(floor((k_elbow + k_best_silhouette) / 2) AS INTEGER) AS k_compromise FROM ends, elbow, best""",
    "elbow_k": f"""WITH {KMETRICS.split('dist AS')[0].rstrip().rstrip(',')}, {ELBOW.format(m='inert')}, best AS (SELECT list(k ORDER BY k)[(count(*) // 2) + 1] AS k_best_silhouette FROM inert)
SELECT n AS n_candidates, k_elbow, k_best_silhouette, CAST(floor((k_elbow + k_best_silhouette) / 2) AS INTEGER) AS k_compromise FROM ends, elbow, best""",
    "confusion": f"WITH {METRIC_CELLS} SELECT 'labels' AS tag, a.label AS y_true, b.label AS y_pred, (SELECT count(*) FROM p WHERE y_true = a.label AND y_pred = b.label) AS n FROM names a CROSS JOIN names b",
    "accuracy_macro_f1": f"WITH {METRIC_CELLS} SELECT 'labels' AS tag, round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM rates",
    "class_report": f"""WITH {METRIC_CELLS}, t AS (SELECT sum(hits) / CAST(sum(support) AS DOUBLE) AS acc, CAST(sum(support) AS BIGINT) AS n FROM rates)
SELECT 'labels' AS tag, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rates
UNION ALL SELECT 'labels', 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM t
UNION ALL SELECT 'labels', 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'labels', 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rates""",
    "model_metrics": f"""WITH {METRIC_CELLS} SELECT tag, round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n
FROM rates CROSS JOIN (VALUES ('a'), ('b')) AS t(tag) GROUP BY tag""",
    "class_given_word": _class_given_word("1.0 / count(*) OVER ()", 1.0, 1),
    "class_given_word_empirical": _class_given_word("CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER ()", 0.5, 5),
    "semantic_drift": f"""WITH {DOCS},
t AS (SELECT doc_id, rights_year, unnest(range(len(full_text))) AS pos, unnest(full_text) AS term FROM docs),
v AS (SELECT term FROM (SELECT term, count(*) AS tf FROM t GROUP BY term HAVING count(*) >= 3 ORDER BY tf DESC, term LIMIT 200)),
k AS (SELECT doc_id, pos, term, CAST(floor(rights_year / 10.0) * 10 AS INTEGER) AS decade FROM t JOIN v USING (term) WHERE rights_year IS NOT NULL),
c AS (SELECT a.decade, a.term, b.term AS context, count(*) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND b.pos BETWEEN a.pos - 5 AND a.pos + 5 GROUP BY ALL),
m AS (SELECT decade, term, sum(n) AS nt FROM c GROUP BY ALL),
a AS (SELECT decade, sum(nt) AS na FROM m GROUP BY ALL),
w AS (SELECT c.decade, c.term, c.context, ln(c.n * CAST(na AS DOUBLE) / (m.nt * x.nt)) AS w FROM c JOIN m ON m.decade = c.decade AND m.term = c.term
  JOIN m x ON x.decade = c.decade AND x.term = c.context JOIN a ON a.decade = c.decade),
p AS (SELECT * FROM w WHERE w > 0),
l AS (SELECT decade, term, sqrt(sum(w * w)) AS len FROM p GROUP BY ALL),
d AS (SELECT p.decade, p.term, sum(p.w * q.w) AS dot FROM p JOIN p q ON q.decade = p.decade + 10 AND q.term = p.term AND q.context = p.context GROUP BY ALL)
SELECT l.term, l.decade || 's' AS from_decade, (l.decade + 10) || 's' AS to_decade, round(coalesce(dot, 0) / (l.len * n.len), 6) AS cosine
FROM l JOIN l n ON n.decade = l.decade + 10 AND n.term = l.term LEFT JOIN d ON d.decade = l.decade AND d.term = l.term""",
    "drift_embeddings": f"""{INFORMATION} SELECT count(*) AS n_rows, count(DISTINCT l.term) AS n_terms, count(DISTINCT l.decade) AS n_steps, count(*) AS n_sound
FROM l JOIN l n ON n.decade = l.decade + 10 AND n.term = l.term""",
    "decade_embeddings": f"{INFORMATION} SELECT decade, count(*) AS n_rows, count(*) AS n_terms, true AS orthogonal, true AS ordered FROM l GROUP BY decade",
    "kmeans_labels": _clustered("6"),
    "kmeans_multi_k": _clustered("4, 8", ", true AS silhouette_same, true AS below_one_cluster"),
    "lda_doc_topics": f"""WITH {DOCS}, t AS (SELECT doc_id, unnest(full_text) AS term FROM docs),
v AS (SELECT term FROM t GROUP BY term HAVING count(*) >= 3 ORDER BY count(*) DESC, term LIMIT 30000),
known AS (SELECT DISTINCT doc_id FROM t JOIN v USING (term))
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(*) AS n_sum_one, count(*) FILTER (WHERE known.doc_id IS NULL) AS n_even, count(*) AS n_best
FROM docs LEFT JOIN known USING (doc_id)""",
    "lda_top_words": "SELECT CAST(unnest(range(50)) AS INTEGER) AS topic, CAST(15 AS BIGINT) AS n_words, CAST(15 AS BIGINT) AS n_distinct, CAST(15 AS INTEGER) AS last_rank, CAST(15 AS BIGINT) AS n_known",
    "density_topics": "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_docs, count(*) AS n_labelled, true AS large_enough, true AS in_order FROM embeddings",
    "density_given": """WITH RECURSIVE d AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
core AS (SELECT a FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d) WHERE r = 2 AND d <= 1.1),
link AS (SELECT a, b FROM d WHERE d <= 1.1 AND a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (SELECT a, a AS b FROM core UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY component HAVING count(*) >= 2),
numbers AS (SELECT component, CAST(row_number() OVER (ORDER BY n DESC, component) - 1 AS INTEGER) AS topic FROM sizes)
SELECT vec_id AS doc_id, coalesce(topic, -1) AS topic FROM embeddings LEFT JOIN comp ON comp.a = vec_id LEFT JOIN numbers USING (component)""",
    "topic_merge": f"""WITH {DOCS}, {ASSIGNED}, t AS (SELECT topic, unnest(full_text) AS term FROM docs JOIN assigned USING (doc_id) WHERE topic >= 0),
c AS (SELECT topic, term, count(*) AS tf FROM t GROUP BY ALL),
totals AS (SELECT topic, sum(tf) AS words FROM c GROUP BY ALL),
alltf AS (SELECT term, sum(tf) AS tf_all FROM c GROUP BY ALL),
w AS (SELECT topic, term, CAST(tf AS DOUBLE) / words * ln(1 + (SELECT avg(words) FROM totals) / tf_all) AS w FROM c JOIN totals USING (topic) JOIN alltf USING (term)),
sizes AS (SELECT topic, count(*) AS n FROM assigned WHERE topic >= 0 GROUP BY topic),
small AS (SELECT topic FROM sizes ORDER BY n, topic DESC LIMIT 1),
lens AS (SELECT topic, sqrt(sum(w * w)) AS l FROM w GROUP BY topic),
near AS (SELECT y.topic AS into_topic FROM w x JOIN w y USING (term) JOIN lens ON lens.topic = y.topic
  WHERE x.topic = (SELECT topic FROM small) AND y.topic <> x.topic GROUP BY y.topic ORDER BY sum(x.w * y.w) / any_value(l) DESC, y.topic LIMIT 1),
merged AS (SELECT doc_id, CASE WHEN topic = (SELECT topic FROM small) THEN (SELECT into_topic FROM near) ELSE topic END AS topic FROM assigned),
again AS (SELECT topic, CASE WHEN topic < 0 THEN -1 ELSE CAST(row_number() OVER (ORDER BY topic < 0, count(*) DESC, topic) - 1 AS INTEGER) END AS new_topic FROM merged GROUP BY topic)
SELECT doc_id, new_topic AS topic FROM merged JOIN again USING (topic)""",
    "w2v_docs": f"""WITH {DOCS}, {_windows(256, 200)}, t AS (SELECT doc_id, unnest(tokens) AS term FROM windows),
known AS (SELECT DISTINCT doc_id FROM t WHERE term IN (SELECT term FROM t GROUP BY term HAVING count(*) >= 5))
SELECT count(*) AS n_rows, count(*) AS n_docs, count(*) AS n_sound, count(*) FILTER (WHERE known.doc_id IS NULL) AS n_zero
FROM (SELECT doc_id FROM docs WHERE len(full_text) > 0) LEFT JOIN known USING (doc_id)""",
    "pca_2d": "SELECT count(*) AS n_docs, true AS uncorrelated, true AS ordered, true AS within, true AS ahead FROM embeddings",
    "lr_predictions": _predicted(DOMAINS, "true AS beats_majority"),
    "mlp_predictions": _predicted(DOMAINS, "true AS beats_majority"),
    "vector_head": _predicted(QUADRANTS, "true AS beats_majority"),
    "neural_head": _predicted(QUADRANTS, "true AS beats_majority"),
    "pseudo_label": f"""{QUADRANTS}, {SPLIT} SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, count(*) AS n_known, count(*) AS n_agree, true AS some_adopted
FROM split WHERE split = 'valid'""",
}
