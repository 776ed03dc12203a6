"""Queries of prompts, answers and profiles; answers are made from md5 so that every rule of the parsers meets cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slateworks.functions.text import intensity_bucket
from slateworks.operators import profiles, responses, splits, text_scorers
from slateworks.plans import shared, sql
from slateworks.plans.measures import _rounded
from slateworks.plans.registry import query
from slateworks.sources import bindings

_HEX = "CAST('0x' || substr(md5({0}), 1, 2) AS INTEGER)"


def _hex(column: str) -> Column:
    return F.conv(F.substring(F.md5(column), 1, 2), 16, 10).cast("int")


_ANSWERS = f"""a AS (SELECT user_id AS id, {_HEX.format('user_id')} AS h, CASE {_HEX.format('user_id')} % 8 WHEN 0 THEN 'C1: yes' || chr(10) || 'C2: no' WHEN 1 THEN chr(10) || ' c2 : NO ' || chr(10) || chr(10) || 'C1: Yes' WHEN 2 THEN 'C1: yes' WHEN 3 THEN 'C1: yes' || chr(10) || 'C1: no' WHEN 4 THEN 'C1: yes' || chr(10) || 'C3: no' WHEN 5 THEN 'C1 yes' || chr(10) || 'C2: no' WHEN 6 THEN NULL ELSE 'C1: no' || chr(10) || 'C2: maybe' END AS answer FROM (SELECT CAST(c_custkey AS VARCHAR) AS user_id FROM customer))"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["C1: yes\nC2: no", "\n c2 : NO \n\nC1: Yes", "C1: yes", "C1: yes\nC1: no", "C1: yes\nC3: no", "C1 yes\nC2: no", None, "C1: no\nC2: maybe"]
    users = bindings.users(spark, sf_dir).select(F.col("user_id").alias("id"))
    return users.withColumn("answer", F.get(F.array(*(F.lit(t) for t in texts)), _hex("id") % 8))


@query(f"WITH {_ANSWERS}, l AS (SELECT unnest(['C1', 'C2']) AS label) SELECT id, label, CASE WHEN h % 8 IN (0, 1) THEN CASE WHEN label = 'C1' THEN 1 ELSE 0 END END AS y FROM a, l")
def parse_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.parse_yes_no(_answers(spark, sf_dir), "answer", F.lit(2), "id")


@query(f"WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer), l AS (SELECT unnest(['C1', 'C2', 'C3']) AS label), r AS (SELECT id, label, CASE {_HEX.format('id')} % 5 WHEN 0 THEN CASE label WHEN 'C2' THEN 1 WHEN 'C3' THEN 2 ELSE 3 END WHEN 1 THEN CAST(substr(label, 2) AS INTEGER) END AS rank FROM a, l) SELECT id, label, CAST(rank AS BIGINT) AS rank, CAST(3 - rank AS BIGINT) AS score FROM r")
def parse_ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["C2 > C3 > C1", "First C1, then C2.\nC3", "C1, C2", "C1 C2 C3 C3", "C1 C2 C4"]
    users = bindings.users(spark, sf_dir).select(F.col("user_id").alias("id"))
    return responses.parse_ranking(users.withColumn("answer", F.get(F.array(*(F.lit(t) for t in texts)), _hex("id") % 5)), "answer", F.lit(3), "id")


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, CASE {_HEX.format('CAST(c_custkey AS VARCHAR)')} % 7 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 3 END AS rating, CASE {_HEX.format('CAST(c_custkey AS VARCHAR)')} % 7 WHEN 0 THEN 4 WHEN 6 THEN 2 WHEN 1 THEN 5 END AS bare FROM customer")
def parse_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ["RATING: 4", " 5 ", "I like it.\nrating: +3", "RATING: 9", "RATING: 1\nRATING: 2", "four", None]
    bare = ["4", "+5", "3.0", "9", "rating 1", "", " 2"]
    pick = lambda texts: F.get(F.array(*(F.lit(t) for t in texts)), _hex("id") % 7)
    users = bindings.users(spark, sf_dir).select(F.col("user_id").alias("id"))
    allowed = [1, 2, 3, 4, 5]
    return users.select("id", responses.parse_rating(pick(marked), allowed).alias("rating"), responses.parse_integer(pick(bare), allowed).alias("bare"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS id, CASE {_HEX.format('CAST(c_custkey AS VARCHAR)')} % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS y, CASE {_HEX.format('CAST(c_custkey AS VARCHAR)')} % 4 WHEN 0 THEN 'it fits' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN 'x' END AS reason, CASE {_HEX.format('CAST(c_custkey AS VARCHAR)')} % 4 WHEN 0 THEN 'old films | long ones' WHEN 1 THEN 'new' END AS taste FROM customer")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = ["WATCH: yes\nREASON: it fits", "watch : No\nReason: two\nlines\nMORE: z", "WATCH: yes\nWATCH: no\nREASON: x", "nothing"]
    tastes = ["TASTE: old films\nHIGH: long ones", "taste: new", "REASON: none", ""]
    pick = lambda texts: F.get(F.array(*(F.lit(t) for t in texts)), _hex("id") % 4)
    users = bindings.users(spark, sf_dir).select(F.col("user_id").alias("id"))
    y, reason = responses.parse_decision(pick(decisions), "WATCH")
    return users.select("id", y.alias("y"), reason.alias("reason"), responses.parse_taste(pick(tastes)).alias("taste"))


_TEST = f"WITH {sql.alignment()}, t AS (SELECT * FROM scored WHERE split = 'test')"


@query(f"{_TEST}, c AS (SELECT user_id, grp, item_id, row_number() OVER (PARTITION BY grp ORDER BY item_id) AS n FROM t), h AS (SELECT user_id, string_agg(item_id, chr(10) ORDER BY ts, item_id) AS past FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS rk FROM split WHERE split = 'train') WHERE rk <= 3 GROUP BY 1), q AS (SELECT user_id, grp, string_agg('C' || n || ' ' || item_id, chr(10) ORDER BY n) AS asked FROM c GROUP BY 1, 2) SELECT grp, 'What this person chose before:' || chr(10) || coalesce(past, 'nothing known') || chr(10) || chr(10) || 'Would they choose each of these?' || chr(10) || asked || chr(10) || chr(10) || 'Answer with a line for each, as C1: yes or C1: no.' AS prompt FROM q LEFT JOIN h USING (user_id)")
def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("grp", "prompt")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slateworks.operators.scorers import history

    test = shared.scored(spark, sf_dir).where("split = 'test'")
    labelled = responses.labelled_candidates(test, "item_id", "grp")
    past = history(splits.temporal_position(shared.split(spark, sf_dir).where("split = 'train'")), 3).select("user_id", "position", F.col("item_id").alias("line"))
    return responses.prompts(labelled, past, F.col("item_id"), "grp")


@query()
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts answered by the stub client in Arrow batches, parsed; rows only, as an endpoint is not SQL."""
    asked = responses.ask(_prompts(spark, sf_dir), responses.stub_client(), lambda a: a.startswith("C1:"))
    n = F.size(F.split("prompt", "\nC")) - 1
    return responses.parse_yes_no(asked.withColumn("n", n), "answer", "n", "grp")


@query(f"{_TEST}, s AS (SELECT user_id, grp, string_agg(item_id, '|' ORDER BY item_id) AS signature FROM t GROUP BY 1, 2) SELECT user_id, grp, md5(signature) AS signature, row_number() OVER (PARTITION BY user_id, signature ORDER BY grp) = 1 AS first FROM s")
def batch_signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = shared.scored(spark, sf_dir).where("split = 'test'")
    out = responses.batch_signatures(test, "score", False, "user_id", "grp")
    return out.withColumn("signature", F.md5("signature"))


@query(f"{_TEST} SELECT DISTINCT user_id, item_id FROM t")
def itemwise_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.scoring_units(shared.scored(spark, sf_dir).where("split = 'test'"))


@query(f"WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS id, unnest([0, 1, 2, 3]) AS run FROM customer), w AS (SELECT id, CASE {_HEX.format('id || run')} % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS score FROM v) SELECT id, CASE WHEN count(score) = 0 THEN NULL WHEN 2 * count_if(score = 1) > count(score) THEN 1 ELSE 0 END AS score FROM w GROUP BY 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = bindings.users(spark, sf_dir).select(F.col("user_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("run"))
    h = F.conv(F.substring(F.md5(F.concat("id", F.col("run").cast("string"))), 1, 2), 16, 10).cast("int") % 3
    return responses.majority(votes.withColumn("score", F.when(h == 0, 1).when(h == 1, 0)), "score", "id")


def _with_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = bindings.items(spark, sf_dir).select("item_id", F.split("title", " ").alias("genres"))
    return shared.kept(spark, sf_dir).join(items, "item_id")


_GENRES = f"""WITH {sql.KEPT}, gx AS (SELECT user_id, unnest(string_split(p_name, ' ')) AS genre FROM kept JOIN part ON CAST(p_partkey AS VARCHAR) = item_id), gc AS (SELECT user_id, genre, count(*) AS n FROM gx GROUP BY 1, 2),
gr AS (SELECT user_id, 5 * sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, genre) <= 4 * sum(n) OVER (PARTITION BY user_id) AS within FROM gc), gb AS (SELECT user_id, greatest(count_if(within), 1) AS d FROM gr GROUP BY 1)"""


@query(f"""{_GENRES}, im AS (SELECT item_id, avg(rating) AS mr FROM kept GROUP BY 1), b AS (SELECT user_id, count(*) AS a, avg((rating - mr) * (rating - mr)) AS c FROM kept JOIN im USING (item_id) GROUP BY 1), p AS (SELECT b.user_id, a, c, CAST(coalesce(d, 0) AS BIGINT) AS d FROM b LEFT JOIN gb USING (user_id)),
q AS (SELECT quantile_cont(a, 0.6) AS a1, quantile_cont(a, 0.9) AS a2, quantile_cont(c, 0.33) AS c1, quantile_cont(c, 0.66) AS c2, quantile_cont(d, 0.25) AS d1, quantile_cont(d, 0.8) AS d2 FROM p)
SELECT user_id, CAST(a AS BIGINT) AS activity, round(c, 9) AS conformity, d AS diversity, CAST(CASE WHEN a <= a1 THEN 1 WHEN a <= a2 THEN 2 ELSE 3 END AS BIGINT) AS activity_tier, CAST(CASE WHEN c <= c1 THEN 1 WHEN c <= c2 THEN 2 ELSE 3 END AS BIGINT) AS conformity_tier, CAST(CASE WHEN d <= d1 THEN 1 WHEN d <= d2 THEN 2 ELSE 3 END AS BIGINT) AS diversity_tier FROM p, q""")
def user_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.traits(_with_genres(spark, sf_dir)))


@query(f"WITH {sql.KEPT}, x AS (SELECT user_id, item_id, CASE WHEN playtime * 4 <= 0 THEN 'zero' WHEN playtime * 4 < 120 THEN 'low' WHEN playtime * 4 < 600 THEN 'medium' ELSE 'high' END AS bucket, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS p FROM kept), y AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY p DESC) AS rk FROM x) SELECT user_id, bucket, string_agg(item_id, '; ' ORDER BY p) AS titles FROM y WHERE rk <= 10 GROUP BY 1, 2")
def taste_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.temporal_position(shared.kept(spark, sf_dir)).withColumn("bucket", intensity_bucket(F.col("playtime") * 4))
    return profiles.taste_buckets(rows, "bucket", "item_id")


@query("WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer), c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'old' AS value FROM customer WHERE c_custkey % 3 = 0) SELECT id, coalesce(value, 'miss') AS value FROM r LEFT JOIN c USING (id)")
def profile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits come from the cache's first row of a key; misses are what would be asked."""
    requests = bindings.users(spark, sf_dir).select(F.col("user_id").alias("id"))
    third = requests.where(F.col("id").cast("long") % 3 == 0)
    cache = third.select("id", F.lit("old").alias("value"), F.lit(1).alias("line")).union(third.select("id", F.lit("new"), F.lit(2)))
    hits, misses = profiles.cached(requests, cache, "id")
    return hits.select("id", "value").union(misses.select("id", F.lit("miss")))


_DIGIT = "CAST('0x' || substr(md5(item_id), 1, 1) AS INTEGER)"
_ANSWERED = {
    "yes_no": f"{_TEST} SELECT user_id, grp, item_id, CAST({_DIGIT} % 2 AS DOUBLE) AS score FROM t",
    "listwise": f"{_TEST} SELECT user_id, grp, item_id, CAST(count(*) OVER (PARTITION BY grp) - row_number() OVER (PARTITION BY grp ORDER BY md5(item_id)) AS DOUBLE) AS score FROM t",
    "rating": f"{_TEST} SELECT user_id, grp, item_id, CAST({_DIGIT} % 5 + 1 AS DOUBLE) AS score FROM t",
}


def _text_scored(spark: SparkSession, sf_dir: str, runs: int = 1, **form) -> DataFrame:
    """The test candidates scored by the stub in one of the forms."""
    scorer = text_scorers.TextScorer(**form)
    test = shared.scored(spark, sf_dir).where("split = 'test'").select("user_id", "grp", "item_id")
    if scorer.profile:
        users = test.select("user_id").distinct()
        tastes, _ = profiles.generated_tastes(users.select("user_id", F.lit("What is this person's taste?").alias("prompt")), users.limit(0).select("user_id", F.lit("").alias("value"), F.lit(0).alias("line")), taste_client(), "user_id")
        known = text_scorers.profile_text(profiles.traits(_with_genres(spark, sf_dir)).join(tastes, "user_id"))
    else:
        from slateworks.operators.scorers import history

        past = history(splits.temporal_position(shared.split(spark, sf_dir).where("split = 'train'")), 10)
        listed = past.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("position", "item_id"))).alias("h"))
        known = listed.select("user_id", F.array_join(F.transform("h", lambda x: x["item_id"]), "\n").alias("past"))
    out = text_scorers.score(scorer, test, known, text_scorers.line_client(scorer), runs)
    return out.select("user_id", "grp", "item_id", "score")


def taste_client():
    def make():
        return lambda prompt: "TASTE: I like what lasts\nREASON: a stub says so\nHIGH: old\nLOW: new"

    return make


@query(_ANSWERED["yes_no"])
def text_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir)


@query(_ANSWERED["yes_no"])
def text_yes_no_itemwise_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of user and item asked once in each of three runs; the votes' majority goes back to all rows."""
    return _text_scored(spark, sf_dir, 3, itemwise=True)


@query(_ANSWERED["yes_no"])
def text_preference_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, target="preference")


@query(_ANSWERED["listwise"])
def text_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, kind="listwise")


@query(_ANSWERED["listwise"])
def text_preference_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, kind="listwise", target="preference")


@query(_ANSWERED["rating"])
def text_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, kind="rating")


@query(_ANSWERED["yes_no"])
def profile_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, profile=True, itemwise=True)


@query(_ANSWERED["yes_no"])
def profile_preference_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, profile=True, target="preference")


@query(_ANSWERED["listwise"])
def profile_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, profile=True, kind="listwise")


@query(_ANSWERED["listwise"])
def profile_preference_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, profile=True, kind="listwise", target="preference")


@query(_ANSWERED["rating"])
def profile_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_scored(spark, sf_dir, profile=True, kind="rating")
