"""One query for each operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferryline.llm import (
    cotraining,
    cover_tree,
    difference_cover,
    licences,
    mixing,
    pieces,
    resampling,
    runs,
    sharding,
    simhash,
    spotsigs,
    token_files,
    url_cascade,
)
from ferryline.llm.common import PLAIN_WORD, WORD, table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_cover_tree", f"""
    WITH vectors AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scores
    WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER best <= {cover_tree.K}""")
def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op3_cotraining")
def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_spotsigs")
def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


# The rules of the contract, and hosts whose pages are never wanted.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BLOCKED_HOSTS = ["ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com"]

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULES = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))


@query("op4_url_cascade", f"""
    WITH parts AS (
        SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                                  '{url_cascade.UPPER}', '{url_cascade.LOWER}') AS host,
               coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, url
        FROM pages),
    ruled AS (
        SELECT *, CASE {" ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for _, h, p in _RULES)} END AS rule FROM parts),
    listed AS (
        SELECT host FROM parts WHERE host <> '' GROUP BY host
        HAVING 3 * count(*) FILTER (regexp_matches(url, '[?&](utm_|ref=)')) >= count(*)
        UNION VALUES {", ".join(f"('{h}')" for h in BLOCKED_HOSTS)}),
    blocked AS (
        SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM parts) h JOIN listed l
        ON h.host = l.host OR ends_with(h.host, '.' || l.host))
    SELECT page_id, host, path, rule,
           CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in _RULES)}
                WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled""")
def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    never = spark.createDataFrame([(host,) for host in BLOCKED_HOSTS], "host string")
    return url_cascade.judge(pages, URL_RULES, url_cascade.tracked_hosts(pages).union(never))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op9_mixing", f"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))[1:8])::BIGINT / 4294967296.0::DOUBLE AS draw
        FROM documents),
    sources AS (
        SELECT source, sum(size)::HUGEINT AS n,
               [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1]::HUGEINT AS weight
        FROM sized GROUP BY source),
    levels AS (  -- stopped sources are those of least room per weight
        SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER below, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS shares
        FROM sources
        WINDOW below AS (ORDER BY n::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (SELECT rest, shares FROM levels WHERE weight::DOUBLE * rest::DOUBLE <= 3 * n::DOUBLE * shares::DOUBLE
              ORDER BY shares DESC LIMIT 1),
    targets AS (
        SELECT source, n, CASE WHEN n = 0 OR weight::DOUBLE * rest::DOUBLE > 3 * n::DOUBLE * shares::DOUBLE THEN (3 * n)::DOUBLE
                               ELSE weight::DOUBLE * rest::DOUBLE / shares::DOUBLE END AS target
        FROM sources, level)
    SELECT doc_id, size, n::BIGINT AS source_size, target,
           size * CASE WHEN n = 0 THEN 0 ELSE floor(target / n::DOUBLE)::BIGINT
                       + (draw < target / n::DOUBLE - floor(target / n::DOUBLE))::BIGINT END AS taken
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op6_pieces")
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op7_substrings")
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = difference_cover.remove_repeats(table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten, by its id, repeats a block of its words to its end (the contract's data)."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(mark / 10).cast("long")
    n, a, p = F.col("_n"), F.col("_a"), F.col("_p")
    words = F.when(mark % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    cut = docs.select("doc_id", "text", g.alias("_g"), words.alias("_words")).withColumn("_n", F.size("_words").cast("long"))
    spots = cut.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int")).withColumn(
        "_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    block = F.slice("_words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return spots.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_runs")
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", runs.highest_run())
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


_PLAIN_WORDS = f"regexp_extract_all(translate(text, '{url_cascade.UPPER}', '{url_cascade.LOWER}'), '{PLAIN_WORD}')"


@query("op13_resampling", f"""
    WITH crc_table AS (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS entries
        FROM range(256) AS bytes(i)),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_PLAIN_WORDS}, []) AS words FROM documents),
    features AS (SELECT r, unnest(words) AS word FROM docs),
    wanted AS (SELECT unnest({_PLAIN_WORDS}) AS word FROM benchmark),
    kinds AS (
        SELECT word, list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: ('0x' || hex(encode(word))[i:i + 1])::BIGINT) AS bytes
        FROM (SELECT word FROM features UNION SELECT word FROM wanted)),
    hashed AS (
        SELECT word, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295))
                     % {resampling.BUCKETS} AS bucket
        FROM kinds, crc_table),
    s AS (SELECT bucket, count(*) AS n FROM features JOIN hashed USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT count(*) FROM features)::DOUBLE + {resampling.BUCKETS})
                             / ((s.n::DOUBLE + 1) * ((SELECT count(*) FROM wanted)::DOUBLE + {resampling.BUCKETS}))))::BIGINT AS gain
        FROM s LEFT JOIN t USING (bucket)),
    weights AS (
        SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
        FROM features JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
    scored AS (
        SELECT r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT
                                                           + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
        FROM docs LEFT JOIN weights USING (r)),
    ranked AS (
        SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM scored
        WHERE n_words >= {resampling.LEAST_WORDS}
        QUALIFY row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) <= {resampling.PERCENT} * count(*) OVER () // 100)
    SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranked USING (r)""")
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _rows(rows: list[tuple]) -> str:
    """Rows of a VALUES list."""
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_LICENCES = [*licences.PHRASES, *licences.TEMPLATES]
_LICENCE_PHRASES = sorted({phrase for t in _LICENCES for phrase, _ in t.keys()})


@query("op12_licences", f"""
    WITH template(t, label, need, indexed, n_keys, length, plain) AS (VALUES {_rows([
        (t, x.label, 1 if x.exact else licences.NEED, 1 if x.exact else licences.RARE, len(x.keys()), len(x.split()),
         x in licences.PHRASES) for t, x in enumerate(_LICENCES)])}),
    template_word(t, i, word) AS (VALUES {_rows([(t, i, w) for t, x in enumerate(_LICENCES) for i, w in enumerate(x.split())])}),
    phrase_word(phrase, i, word, length) AS (VALUES {_rows([
        (p, i, w, len(p.split())) for p in _LICENCE_PHRASES for i, w in enumerate(p.split())])}),
    template_phrase(t, phrase, i) AS (VALUES {_rows([(t, p, i) for t, x in enumerate(_LICENCES) for p, i in x.keys()])}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_PLAIN_WORDS}, []) AS words FROM documents),
    spread AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS spot FROM docs),
    hits AS (SELECT * FROM spread WHERE word IN (SELECT word FROM template_word)),
    counts AS (SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word),
    rare AS (
        SELECT t, i, word, need FROM template_word JOIN counts USING (word) JOIN template USING (t)
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY n, word, i) <= indexed),
    begun AS (SELECT r, t, spot - i AS start FROM hits JOIN rare USING (word) GROUP BY r, t, spot - i, need HAVING count(*) >= need),
    phrases AS (
        SELECT r, phrase, spot - i AS start FROM hits JOIN phrase_word USING (word)
        GROUP BY r, phrase, spot - i, length HAVING count(*) = length),
    held AS (
        SELECT r, t, start - i AS start FROM phrases JOIN template_phrase USING (phrase) JOIN template USING (t)
        GROUP BY r, t, start - i, n_keys HAVING count(*) = n_keys),
    plain AS (SELECT r, t, start FROM held JOIN template USING (t) WHERE plain),
    found AS (
        SELECT r, t, start FROM plain
        UNION SELECT r, t, start FROM held JOIN begun USING (r, t, start)),
    base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
                    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
             FROM plain JOIN template USING (t) GROUP BY r),
    every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found JOIN template USING (t) GROUP BY r),
    inside AS (SELECT r, count(DISTINCT spot) AS n_inside FROM spread JOIN found USING (r) JOIN template USING (t)
               WHERE spot >= start AND spot < start + length GROUP BY r)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
           last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           CASE WHEN len(words) > 0 THEN coalesce(n_inside, 0)::DOUBLE / len(words)::DOUBLE ELSE 0.0::DOUBLE END AS score
    FROM docs LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN inside USING (r)""")
def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(table(spark, sf_dir, "documents"))
    starts = F.col("places.start")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), licences.label_list("places").alias("base_labels"),
        licences.label_list("places", "matches").alias("labels"), "score")
