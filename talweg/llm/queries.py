"""The registered queries of this subpackage, opN_<name>: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import ball_kmeans, bit_sliced, bpe, chosen_path, line_dedup, mixing, quality, secret_scan, sentence_spans, toxicity, turn_repair, urls, vp_trees


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; `guess` spans are the ones that the guess-cost method adds."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS[:3]),
        F.sha2(joined(of(*secret_scan.KINDS[:3])), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(of("guess")).cast("long").alias("n_guess"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that it repeats, itself or after another one, exactly or nearly."""
    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("lines_.n").alias("n_lines"), F.col("lines_.removed").alias("n_removed"), "text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level ranks, and the bytes that they decode to."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 5-word shingle similarity 0.75 or more."""
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document; thresholds come from its language's and source's sketches."""
    return quality.judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and template verdicts of every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a machine that learns from the labels outside the held-out quarter."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels.filter(~toxicity.held_out("doc_id")))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by integer inner product of every vector whose id is divisible by 50."""
    return bit_sliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the mix of sources to their tempered shares."""
    mixed, _ = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *(F.col(f"mix_.{c}").cast("long").alias(c) for c in ("lane", "block", "release", "deadline", "slot", "position")))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeated spans cover."""
    out = sentence_spans.dedup(_table(spark, sf_dir, "documents"))
    removed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_sentences", "n_removed", removed.alias("removed"), "text")


def op11_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 50, as the trees find them."""
    return vp_trees.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after five rounds of 40 centroids."""
    return ball_kmeans.digest(*ball_kmeans.cluster(_table(spark, sf_dir, "embeddings")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after its damage."""
    rows = _table(spark, sf_dir, "conversations")
    return turn_repair.audited(rows, turn_repair.damaged(rows))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_line_dedup, op3_byte_bpe, op4_exact_top_k, op5_near_duplicates, op6_quality_rules, op7_url_filter, op8_source_mix, op9_toxicity, op10_span_dedup, op11_vp_search, op12_ball_kmeans, op13_turn_repair)}



def _clusters() -> str:
    """Six assignments and five moves of 40 centroids, all vectors being compared with all centroids."""
    nearest = "a{0} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster := cluster)) AS m FROM v, c{0} c GROUP BY r)"
    moved = "c{1} AS MATERIALIZED (SELECT c.cluster, coalesce(x.q, c.q) AS q FROM c{0} c LEFT JOIN (SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (SELECT m.cluster AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{0} JOIN v USING (r), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1) x USING (cluster))"
    steps = ", ".join(f"{nearest.format(i)}, {moved.format(i, i + 1)}" for i in range(5))
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, q) - 1 AS cluster, q FROM (SELECT *, sha256('2:' || vec_id) AS h FROM v) ORDER BY h, vec_id, q LIMIT 40), {steps}, {nearest.format(5)},
f AS (SELECT vec_id, m.cluster AS cluster, m.d AS d FROM a5 JOIN v USING (r))
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.q, ',')) AS centroid_sha256 FROM f JOIN c5 USING (cluster)"""


def _repairs() -> str:
    """The repair as a forward DP: a list's four structs are the cheapest way to each grammar state (cost, then least audit, then the lines
    it leaves), and a row is a list of one struct: fault (1 truncated, 2 to be deleted), role, text."""

    def more(x: str, cost: str, edit: str, line: str) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN struct_pack(cost := {x}.cost + {cost}, audit := {x}.audit || '{edit}', lines := {x}.lines || {line}) END"

    def keep(x: str, initial: str) -> str:
        return f"CASE WHEN r[1].cost < 2 AND left(r[1].audit, 1) = '{initial}' THEN {more(x, late, 'K', '[r[1].audit || chr(58) || r[1].lines[1]]')} END"

    def rerole(x: str, role: str) -> str:
        return f"CASE WHEN r[1].cost < 2 THEN {more(x, f'1 + {late}', 'R', f'[{chr(39)}{role}:{chr(39)} || r[1].lines[1]]')} END"

    def insert(x: str, role: str) -> str:
        return more(x, "5", "I", f"['{role}:']")

    late = "5 * r[1].cost"
    delete = lambda i: more(f"x[{i}]", "2", "D", "[]")  # noqa: E731
    inserted = f"list_transform([{{0}}], lambda b: list_transform([[b[1], b[2], list_min([b[3], {', '.join(insert(f'b[{i}]', 'user') for i in (1, 2, 4))}]), b[4]]], lambda c: [c[1], c[2], c[3], list_min([c[4], {insert('c[3]', 'assistant')}])])[1])[1]"
    users = ", ".join(f"{keep(f'x[{i}]', 'u')}, {rerole(f'x[{i}]', 'user')}" for i in (1, 2, 4))
    step = f"list_transform([{inserted.format('a')}], lambda x: [{delete(1)}, list_min([{delete(2)}, {keep('x[1]', 's')}]), list_min([{delete(3)}, {users}]), list_min([{delete(4)}, {keep('x[3]', 'a')}, {rerole('x[3]', 'assistant')}])])[1]"
    return rf"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS h FROM k),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut, left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair FROM n),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (n > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
list([struct_pack(cost := CASE WHEN blank OR again THEN 2 WHEN cut THEN 1 ELSE 0 END, audit := role, lines := [text])] ORDER BY n) AS rows FROM f GROUP BY conv_id),
p AS (SELECT *, list_reduce(list_concat([[struct_pack(cost := 0, audit := '', lines := CAST([] AS VARCHAR[])), NULL, NULL, NULL]], rows), lambda a, r: {step}) AS a FROM c),
e AS (SELECT *, list_transform([{inserted.format('a')}], lambda x: list_min([x[1], x[4]]))[1] AS best FROM p)
SELECT i.conv_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""


#: SQL of the queries that it can express; the others are held against brute force in tests.
ORACLES: dict[str, str] = {
    "op12_ball_kmeans": _clusters(),
    "op13_turn_repair": _repairs(),
    "op4_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op5_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a WHERE e.b > r.root), c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
