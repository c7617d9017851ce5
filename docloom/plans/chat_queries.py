"""Queries of the chat side: messages, clipping, streams of answers, heartbeats."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import tex
from docloom.operators import chat
from docloom.plans.base import query
from docloom.streaming import sessions

_MODELS = ("gpt-4-32k", "gpt-3.5-turbo-16k", "gpt-4", "gpt-3.5-turbo", "qwen-plus", "glm-4", "other-model")


def _models(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in _MODELS])).alias("model"))


@query(f"""SELECT model, (CASE WHEN contains(model, '16k') THEN 16384 WHEN contains(model, '32k') THEN 32768 WHEN contains(model, 'gpt-4') THEN 8192 ELSE 4096 END)::BIGINT AS max_tokens FROM (SELECT unnest({list(_MODELS)}) AS model)""")
def model_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark).select("model", tex.model_limit(F.col("model")).cast("long").alias("max_tokens"))


@query(f"""SELECT model, regexp_matches(model, '^(gpt-|chatgpt-|api2d-|azure-|spark|zhipuai|glm-|qwen)') AS concurrent FROM (SELECT unnest({list(_MODELS)}) AS model)""")
def model_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark).select("model", tex.is_concurrent(F.col("model")).alias("concurrent"))


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(turns.alias("turns"))


@query("""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, 0::BIGINT AS place, 'system' AS role, 'be brief' AS content FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT conv_id, k::BIGINT, CASE WHEN k = n OR k % 2 = 1 THEN 'user' ELSE 'assistant' END, text FROM t""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _histories(spark, sf_dir)
    n = F.size("turns")
    built = chat.messages(F.lit("be brief"), F.slice("turns", F.lit(1), n - 1), F.element_at("turns", n))
    return rows.select("conv_id", F.posexplode(built).alias("place", "m")).select("conv_id", F.col("place").cast("long").alias("place"), "m.role", "m.content")


_HISTORY = """WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
h AS (SELECT conv_id AS id, max(CASE WHEN k = n THEN text END) AS text, coalesce(list(text ORDER BY k) FILTER (k < n), []) AS history FROM t GROUP BY conv_id),
a AS (SELECT id, text, length(text) < 500 AS whole, CASE WHEN length(text) < 500 THEN history ELSE list_prepend(text, history) END AS items, CASE WHEN length(text) < 500 THEN 1000 - length(text) ELSE 1000 END AS budget FROM h),
s(id, text, whole, items, budget, step, n) AS (
  SELECT *, coalesce(list_max(list_transform(items, lambda x: length(x))), 0) // 16, 0 FROM a
  UNION ALL
  SELECT id, text, whole, list_transform(items, lambda x, i: CASE WHEN i = list_position(list_transform(items, lambda y: length(y)), list_max(list_transform(items, lambda y: length(y)))) THEN left(x, greatest(0, length(x) - step - 1)::INT) ELSE x END), budget, step, n + 1
  FROM s WHERE len(items) > 0 AND length(array_to_string(items, chr(10))) > budget AND list_max(list_transform(items, lambda x: length(x))) > 0)
SELECT id, CASE WHEN whole THEN text ELSE items[1] END AS text, array_to_string(CASE WHEN whole THEN items ELSE items[2:] END, chr(31)) AS history FROM (SELECT *, max(n) OVER (PARTITION BY id) AS last FROM s) WHERE n = last"""


@query(_HISTORY)
def history_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _histories(spark, sf_dir)
    n = F.size("turns")
    return chat.clipped(rows.select(F.col("conv_id").alias("id"), F.element_at("turns", n).alias("text"), F.slice("turns", F.lit(1), n - 1).alias("history")), 1000).withColumn("history", F.array_join("history", "\x1f"))


@query("""SELECT user_id AS request_id, string_agg(CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END, '' ORDER BY event_id) AS text FROM events GROUP BY user_id""")
def sse_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deltas of answers; every seventh line is malformed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    body = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "event_type", F.lit('"}}]}'))
    lines = events.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 7 == 0, F.lit("data: {broken")).otherwise(body).alias("line"))
    return chat.sse_fold(lines)


@query("""SELECT user_id, event_id, gap FROM (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 1000000 AS gap FROM events) WHERE gap > 5""")
def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events more than five seconds after the user's last one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gap = F.floor((F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1_000_000)
    return events.select("user_id", "event_id", gap.alias("gap")).where("gap > 5")


@query("""SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, count(*) AS done, sum(count(*)) OVER (ORDER BY time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS so_far FROM events GROUP BY time_bucket(INTERVAL 1 HOUR, ts)""")
def progress_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hours = events.groupBy(F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour")).agg(F.count("*").alias("done"))
    # One row an hour: the running total may stand in one partition.
    return hours.select("hour", "done", F.sum("done").over(Window.orderBy("hour")).alias("so_far"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of streaming.sessions; tests run the stream over the same files."""
    found = sessions.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")
