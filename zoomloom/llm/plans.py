"""Queries of the training-data problems, with their SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoomloom.llm.crowds import crowd_members, describe_crowds
from zoomloom.llm.packing import pack
from zoomloom.llm.percentiles import multi_select, read_summaries, sorted_runs, summarize
from zoomloom.llm.sentences import sentence_units
from zoomloom.llm.tokenizer import count_tokens, encode_corpus
from zoomloom.llm.topn import top_n
from zoomloom.session import materialize, table

KEYS = ["canvas_id", "query_type"]
MEASURES = ["fetch_time_ms", "rows_fetched"]


def _valid_log(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """One row a record of stats, with invalid measurements null; rows without key or measurement left out."""
    t = table(spark, d, "stats")
    ok = [F.when(F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double")) & (F.col(m) >= 0), F.col(m)).alias(m) for m in MEASURES]
    t = t.where(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()).select("id", *KEYS, *ok, *more)
    return t.where(F.col(MEASURES[0]).isNotNull() | F.col(MEASURES[1]).isNotNull()).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups with a slow 95th percentile or a large median."""
    runs = materialize(sorted_runs(_valid_log(spark, d), KEYS, MEASURES))
    exact = multi_select(runs, KEYS, [("fetch_time_ms", 0.95), ("rows_fetched", 0.5)])
    hit = ((F.col("measure") == "fetch_time_ms") & (F.col("value") > 500)) | ((F.col("measure") == "rows_fetched") & (F.col("value") > 4000))
    return exact.where(hit).select(*KEYS, "measure")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles and tail percentiles of both measures in every group."""
    runs = materialize(sorted_runs(_valid_log(spark, d), KEYS, MEASURES))
    return multi_select(runs, KEYS, [(m, s) for m in MEASURES for s in (0.25, 0.5, 0.75, 0.95, 0.99)])


def p2_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the whole read from summaries made day by day, with their rank error."""
    daily = _valid_log(spark, d, "logged_at").withColumn("day", F.to_date("logged_at")).drop("logged_at")
    summaries = materialize(summarize(sorted_runs(daily, ["day", *KEYS], MEASURES), ["day", *KEYS], 200))
    return read_summaries(summaries, KEYS, [0.5, 0.95])


def p2_days_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile read from the daily summaries keeps its stated rank error, counted over all values."""
    read = materialize(p2_from_days(spark, d))
    log = _valid_log(spark, d)
    values = functools.reduce(DataFrame.unionByName, [log.where(F.col(m).isNotNull()).select(*KEYS, F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in MEASURES])
    seen = values.join(read, [*KEYS, "measure"]).groupBy(*KEYS, "measure", "share", "n", "value", "rank_error")
    told = seen.agg(F.sum((F.col("x") < F.col("value")).cast("long")).alias("lt"), F.sum((F.col("x") <= F.col("value")).cast("long")).alias("le"))
    want = F.ceil(F.col("n") * F.col("share") - F.lit(1e-9))
    return told.select(*KEYS, "measure", "share", "n", ((F.col("lt") - F.col("rank_error") < want) & (want <= F.col("le") + F.col("rank_error")) & (F.col("rank_error") <= F.col("n") / 100)).alias("within"))


def _counting_games(spark: SparkSession, d: str) -> DataFrame:
    """The last sent row of each game, if it is complete; the home team in its plain form."""
    t = table(spark, d, "games").where(F.col("game_id").isNotNull())
    last = t.groupBy("game_id").agg(F.max_by(F.struct("home_team", "agg_rank", "home_score", "away_score"), "id").alias("g")).select("game_id", "g.*")
    team = F.upper(F.regexp_replace("home_team", r"^\s+|\s+$", ""))
    return last.where(F.col("agg_rank").isNotNull() & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).withColumn("home_team", team)


GAME_ORDER = [("agg_rank", "asc"), ("home_score + away_score", "desc"), ("home_score", "desc"), ("game_id", "asc")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The first three games of every home team."""
    return top_n(_counting_games(spark, d), "home_team", GAME_ORDER, 3).select("home_team", "game_id")


def _placed_dots(spark: SparkSession, d: str) -> DataFrame:
    dots = table(spark, d, "bbox_dots_pushdown_uniform_toplayer0")
    return dots.where(~((F.col("cx") == 0) & (F.col("cy") == 0))).select("id", F.col("cx").alias("x"), F.col("cy").alias("y"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of every crowd of at least 20 dots linked within 40 units."""
    return crowd_members(_placed_dots(spark, d), 40.0, 20)


def _described(spark: SparkSession, d: str) -> DataFrame:
    return describe_crowds(materialize(p4_found(spark, d)), _placed_dots(spark, d))


def p4_crowds(spark: SparkSession, d: str) -> DataFrame:
    """Size, centre and radius of every crowd."""
    return _described(spark, d).select("cluster_id", "size", *[F.round(c, 4).alias(c) for c in ("center_x", "center_y", "radius")])


def p4_typical(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every crowd by Ward's dendrogram, the centre of the main one, and the most typical dots."""
    return _described(spark, d).select("cluster_id", "parts", "main_x", "main_y", "typical")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


CONTAINER_KINDS = 1_000  # rows of context_sizes at most; it has three at any size
LOSS_SHARE = 0.9  # of the capacity: the loss-bearing tokens a container may hold


def _limits(capacity: int) -> tuple[int, int]:
    """Most segments (one for each 128 tokens, four at least) and most loss-bearing tokens of a container."""
    return max(4, capacity // 128), max(1, int(capacity * LOSS_SHARE))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Which piece of which document lies in which container, for every container size.

    Loss is borne by tokens that hold a letter; blanks, digits and punctuation alone bear none. A container has at most `_limits`.
    """
    kinds = table(spark, d, "context_sizes").where("set_name is not null and tokenizer is not null and capacity > 0").limit(CONTAINER_KINDS + 1).collect()
    if len(kinds) > CONTAINER_KINDS:
        raise ValueError("too many kinds of containers")
    names = sorted({r["tokenizer"] for r in kinds})
    sizes = materialize(count_tokens(table(spark, d, "documents"), "doc_id", "text", names))
    out = None
    for r in kinds:
        name, (segments, loss) = r["tokenizer"], _limits(r["capacity"])
        packed = pack(sizes, "doc_id", f"n_{name}", r["capacity"], most_segments=segments, loss=f"letters_{name}", most_loss=loss)
        packed = packed.select(F.lit(r["set_name"]).alias("set_name"), F.lit(r["capacity"]).alias("capacity"), "container_id", "doc_id", "piece_no", "start_token", "n_tokens", "n_loss")
        out = packed if out is None else out.unionByName(packed)
    return out.drop("capacity")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every document."""
    return sentence_units(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p2_from_days": p2_from_days,
    "p2_days_bound": p2_days_bound,
    "p4_found": p4_found,
    "p4_crowds": p4_crowds,
    "p4_typical": p4_typical,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
}

_LOG = """WITH v AS (SELECT DISTINCT id, canvas_id, query_type,
    CASE WHEN fetch_time_ms >= 0 AND NOT isnan(fetch_time_ms) THEN fetch_time_ms END AS a, CASE WHEN rows_fetched >= 0 THEN CAST(rows_fetched AS DOUBLE) END AS b
  FROM stats WHERE canvas_id IS NOT NULL AND query_type IS NOT NULL),
m AS (SELECT canvas_id, query_type, 'fetch_time_ms' AS measure, a AS x FROM v WHERE a IS NOT NULL UNION ALL SELECT canvas_id, query_type, 'rows_fetched', b FROM v WHERE b IS NOT NULL)
"""

_CROWDS = """WITH RECURSIVE d AS (SELECT DISTINCT id, cx, cy FROM bbox_dots_pushdown_uniform_toplayer0 WHERE id IS NOT NULL AND abs(cx) < 'inf'::DOUBLE AND abs(cy) < 'inf'::DOUBLE AND NOT (cx = 0 AND cy = 0)),
n AS (SELECT id, cx, cy, floor(cx / 40) + i AS u, floor(cy / 40) + j AS v FROM d, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j)),
e AS (SELECT DISTINCT d.id AS a, n.id AS b FROM d JOIN n ON floor(d.cx / 40) = n.u AND floor(d.cy / 40) = n.v WHERE (d.cx - n.cx) ** 2 + (d.cy - n.cy) ** 2 <= 1600),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY a HAVING count(*) >= 20)
"""

ORACLE = {
    "p4_found": _CROWDS + "SELECT cluster_id, id FROM m",
    "p4_crowds": _CROWDS + """SELECT cluster_id, count(*) AS size, round(avg(cx), 4) AS center_x, round(avg(cy), 4) AS center_y, round(sqrt(greatest(0, var_pop(cx) + var_pop(cy))), 4) AS radius
FROM m JOIN d USING (id) GROUP BY cluster_id""",
    "p2_found": _LOG + """SELECT canvas_id, query_type, measure FROM m GROUP BY ALL
HAVING (measure = 'fetch_time_ms' AND quantile_disc(x, 0.95) > 500) OR (measure = 'rows_fetched' AND quantile_disc(x, 0.5) > 4000)""",
    "p2_percentiles": _LOG + """SELECT canvas_id, query_type, measure, CAST(share AS DOUBLE) AS share, n, value FROM
  (SELECT canvas_id, query_type, measure, count(*) AS n, quantile_disc(x, [0.25, 0.5, 0.75, 0.95, 0.99]) AS q FROM m GROUP BY ALL),
  LATERAL (SELECT unnest([0.25, 0.5, 0.75, 0.95, 0.99]) AS share, unnest(q) AS value)""",
    "p2_days_bound": _LOG + """SELECT canvas_id, query_type, measure, CAST(share AS DOUBLE) AS share, n, TRUE AS within FROM
  (SELECT canvas_id, query_type, measure, count(*) AS n FROM m GROUP BY ALL), LATERAL (SELECT unnest([0.5, 0.95]) AS share)""",
    "p5_found": r"""WITH last AS (SELECT game_id, arg_max({'t': home_team, 'r': agg_rank, 'h': home_score, 'a': away_score}, id) AS g FROM games WHERE game_id IS NOT NULL GROUP BY game_id),
c AS (SELECT upper(regexp_replace(g.t, '^\s+|\s+$', '', 'g')) AS home_team, game_id, g.r AS r, g.h AS h, g.a AS a FROM last WHERE g.r IS NOT NULL AND g.h IS NOT NULL AND g.a IS NOT NULL AND g.t IS NOT NULL)
SELECT home_team, game_id FROM c QUALIFY row_number() OVER (PARTITION BY home_team ORDER BY r, h + a DESC, h DESC, game_id) <= 3""",
}
