"""The registered queries of the grading engine, over tables that adapters derive from the driver's, and their DuckDB SQL.

An adapter is one SQL text that both engines run; `@name@` stands for a table. The text tables hold no formulas or boxed
answers, so adapters build such texts from `part` in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import answers as A
from gradeloom.functions import parse as P
from gradeloom.functions import symbols as S
from gradeloom.functions import text as X
from gradeloom.operators import catalog, graph, judge, marking, rules, scores
from gradeloom.plans import evaluate, verify
from gradeloom.sources import inference, sinks

#: Every event is a result: in REPEATED a question comes several times in a run, in RESULTS each time is a run of its own.
REPEATED = r"""
select cast(e.user_id as string) as question_id, e.event_type as run_id, concat('d', cast(e.user_id % 4 as string)) as dataset, e.event_id as idx,
 e.value as fine_grained_score, cast(regexp_extract(e.props, '([0-9]+)', 1) as double) as coarse_grained_score,
 cast(500 + e.user_id % 5 as double) as max_points, (e.event_id % 3 <> 0) as valid_marking
from @events@ e"""
RESULTS = REPEATED.replace("e.event_type as run_id", "concat(e.event_type, '_', cast(row_number() over (partition by e.user_id, e.event_type order by e.event_id) as string)) as run_id")
SUBMISSIONS = r"""
select p_partkey as id, case when p_partkey % 10 = 0 then concat('speed ', cast(p_size as string), ' then ', cast(p_partkey % 7 as string))
 else concat('Thus ', chr(92), 'boxed{', cast(p_size as string), ' m/s} and ', chr(92), 'boxed{', cast(p_partkey % 7 as string), '}') end as prediction,
 cast(p_size + p_partkey % 2 as string) as gold_1, case when p_partkey % 5 = 0 then p_brand else cast(p_size % 7 as string) end as gold_2,
 cast(1 + p_partkey % 3 as double) as points_1, cast(2 as double) as points_2, cast(p_partkey % 11 as double) / 10 as fine from @part@"""
SOLUTIONS = r"""
select p_partkey as id, concat('v_', cast(p_size % 5 as string), ' = u0 + ', cast(p_partkey % 9 as string), ' * t1', chr(10),
 'v_', cast(p_size % 3 as string), ' = w2 - ', cast(p_partkey % 4 as string), chr(10), 'k_B = ', cast(p_partkey % 6 as string), chr(10),
 case when p_partkey % 2 = 0 then 'We assume an Ideal Gas in steady state.' else 'We neglect air resistance.' end) as text_all from @part@"""
RESPONSES = r"""
select p_partkey as id, case p_partkey % 6 when 0 then concat(chr(92), 'boxed{0.', cast(p_size % 10 as string), '}') when 1 then concat(chr(92), 'boxed{', cast(p_size as string), ' of 60}')
 when 2 then concat('Score: ', cast(p_size as string)) when 3 then concat(cast(p_size as string), ' points') when 4 then concat('I give ', cast(p_size as string), ' out of 60') else '' end as response from @part@"""
SAMPLES = r"""
select conv_id as id, case when conv_id % 3 = 0 then '' else max(case when turn = 0 then text end) end as question,
 max(case when turn = 0 then text end) as prompt, max(case when role = 'system' then text end) as context, max(case when turn = 1 then text end) as output from @conversations@ group by conv_id"""
MARKING = r"""
select l_orderkey as id, l_suppkey % 2 as set_index, l_linenumber as criterion_index, l_partkey as tie, l_discount as score from @lineitem@"""
FIELDS = r"""
select p_partkey as id, case p_partkey % 8 when 0 then concat('[', cast(p_size as string), ', ', cast(p_size + 1 as string), '.5]') when 1 then cast(p_size as string) when 2 then p_brand
 when 3 then '' when 4 then 'nan' when 5 then '[bad' when 6 then '[1, null, 2]' else null end as raw from @part@"""
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LIMIT = 0.2


def _adapt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        sql = sql.replace(f"@{t}@", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def _plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"@{t}@", t)
    return sql


def _query(name: str, adapter: str | None, oracle: str | None, also: str = ""):
    """Registers a function of the adapter's table (or of spark and sf_dir); in the SQL, `r` is that table."""

    def register(f):
        QUERIES[name] = (lambda spark, sf_dir: f(_adapt(spark, sf_dir, adapter))) if adapter else f
        if oracle:
            ORACLES[name] = (f"with r as ({_plain(adapter)}){also} " if adapter else "") + oracle
        return f

    return register


def _results(r: DataFrame) -> DataFrame:
    return r.withColumn("earned_points", scores.earned(F.col("fine_grained_score"), F.col("coarse_grained_score")))


KINDS = (("", "e"), ("_fine", "fine_grained_score"), ("_coarse", "coarse_grained_score"))
EARNED = ", s as (select *, greatest(fine_grained_score, coarse_grained_score) as e from r)"


def _stat_sql(digits: int, median: bool) -> str:
    kinds = [("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")] + [("median", "median")] * median
    return ", ".join(f"round_even({f}({c}), {digits}) as {m}{k}_score" for k, c in KINDS for m, f in kinds)


# --- statistics


@_query("score_cube_stats", RESULTS, f"select question_id, count(*) as num_runs, {_stat_sql(2, False)}, round_even(avg(e) / max(max_points) * 100, 2) as score_rate from s group by question_id", EARNED)
def _(r):
    return scores.question_stats(_results(r), ["question_id"])


FOLD = "list_reduce(list_prepend(0.0::double, list({0} order by idx)), lambda a, x: round_even(a + x, 2))"
A1_SQL = ", t as (select {keys}, " + FOLD.format("fine_grained_score") + " as f, " + FOLD.format("coarse_grained_score") + " as c, " + FOLD.format("e") + " as e, round_even(sum(max_points), 2) as m, count(*) as n from s group by {keys}), d as (select {keys}, f as fine_grained_total_score, case when m > 0 then round_even(f / m * 100, 2) else 0 end as fine_grained_score_rate, c as coarse_grained_total_score, case when m > 0 then round_even(c / m * 100, 2) else 0 end as coarse_grained_score_rate, e as total_score, case when m > 0 then round_even(e / m * 100, 2) else 0 end as score_rate, m as max_possible_score, n as total_count from t)"


@_query("dataset_score", RESULTS, "select * from d", EARNED + A1_SQL.format(keys="dataset, run_id"))
def _(r):
    return scores.dataset_score(_results(r), ["dataset", "run_id"])


QUESTIONS_SQL = ", q as (select dataset, question_id, round_even(avg(e), 2) as mean_score, max(max_points) as max_points from s group by dataset, question_id)"


@_query("overall_run_stats", RESULTS, "select * from (select dataset, count(*) as num_runs, round_even(avg(total_score), 2) as mean_total_score, round_even(stddev_pop(total_score), 2) as std_total_score, round_even(min(total_score), 2) as min_total_score, round_even(max(total_score), 2) as max_total_score, round_even(avg(score_rate), 2) as mean_score_rate, round_even(stddev_pop(score_rate), 2) as std_score_rate from d group by dataset) join (select dataset, count(*) as num_questions, round_even(sum(mean_score), 2) as question_based_mean_score, round_even(sum(max_points), 2) as question_based_max_score, round_even(sum(mean_score) / sum(max_points) * 100, 2) as question_based_score_rate from q group by dataset) using (dataset)", EARNED + A1_SQL.format(keys="dataset, run_id") + QUESTIONS_SQL)
def _(r):
    rows = _results(r)
    stats = scores.question_stats(rows, ["dataset", "question_id", "max_points"])
    return scores.overall_stats(rows, stats, ["dataset"])


@_query("grand_total", RESULTS, "select round_even(sum(total_score), 2) as grand_total_score, round_even(sum(max_possible_score), 2) as grand_max_score, round_even(sum(total_score) / sum(max_possible_score) * 100, 2) as grand_score_rate, count(*) as num_datasets from d", EARNED + A1_SQL.format(keys="dataset"))
def _(r):
    return scores.grand_total(scores.dataset_score(_results(r), ["dataset"]))


@_query("repair_stats_median", RESULTS, f"select question_id, count(*) as num_runs, {_stat_sql(4, True)}, round_even(round_even(avg(e), 4) / max(max_points) * 100, 2) as score_rate from s group by question_id", EARNED)
def _(r):
    return scores.question_stats(_results(r), ["question_id"], 4, True)


@_query("repair_overall", RESULTS, "select dataset, count(*) as total_runs, round_even(avg(e), 4) as mean_score, round_even(stddev_pop(e), 4) as std_score, round_even(min(e), 4) as min_score, round_even(max(e), 4) as max_score, round_even(median(e), 4) as median_score from s group by dataset", EARNED)
def _(r):
    return scores.pooled_stats(_results(r), ["dataset"])


MAXIMA = ", m as (select dataset, sum(p) as m from (select dataset, question_id, max(max_points) as p from r group by all) group by dataset)"


def _questions(r: DataFrame) -> DataFrame:
    return r.groupBy("dataset", "question_id").agg(F.max("max_points").alias("max_points"))


@_query("run_summary", RESULTS, "select dataset, run_id, round_even(sum(e), 4) as total_score, round_even(max(m.m), 4) as max_possible_score, round_even(sum(e) / max(m.m) * 100, 2) as score_rate from s join m using (dataset) group by dataset, run_id", EARNED + MAXIMA)
def _(r):
    return scores.run_summary(_results(r), _questions(r))


@_query("summary_by_file", RESULTS, "select dataset, count(distinct run_id) as num_runs, round_even(sum(e), 2) as total_score, round_even(max(m.m) * count(distinct run_id), 2) as max_possible_score, round_even(avg(e), 4) as mean_score, round_even(stddev_pop(e), 4) as std_score, round_even(sum(e) / (max(m.m) * count(distinct run_id)) * 100, 2) as mean_score_rate, round_even(stddev_pop(e) / max(m.m) * 100, 2) as std_score_rate from s join m using (dataset) group by dataset", EARNED + MAXIMA)
def _(r):
    return scores.summary_by_file(_results(r), _questions(r))


def _runs(r: DataFrame) -> list[str]:
    return [x[0] for x in r.select("run_id").distinct().orderBy("run_id").collect()]


@_query("question_run_pivot", RESULTS, "select question_id, run_id, coalesce(max(e), 0) as earned from (select q.question_id, u.run_id, s.e from (select distinct question_id from r) q cross join (select distinct run_id from r) u left join s on s.question_id = q.question_id and s.run_id = u.run_id and s.valid_marking) group by question_id, run_id", EARNED)
def _(r):
    runs = _runs(r)
    wide = scores.pivot_runs(_results(r).filter("valid_marking"), runs, ["question_id"], questions=r)
    return wide.unpivot("question_id", runs, "run_id", "earned")


@_query("first_run_left_join", RESULTS, "select q.dataset, q.question_id, q.max_points, count(s.run_id) as num_runs, coalesce(round_even(sum(s.e), 2), 0) as total from (select dataset, question_id, max_by(max_points, idx) as max_points from r where run_id = (select min(run_id) from r) and coarse_grained_score > 20 group by dataset, question_id) q left join (select * from s where valid_marking) s on s.dataset = q.dataset and s.question_id = q.question_id group by all", EARNED)
def _(r):
    first = r.agg(F.min("run_id")).first()[0]
    questions = scores.first_run_questions(r.filter((F.col("run_id") != first) | (F.col("coarse_grained_score") > 20)), ["dataset"])
    own = _results(r).filter("valid_marking").drop("max_points")
    return questions.join(own, ["dataset", "question_id"], "left").groupBy("dataset", "question_id", "max_points").agg(F.count("run_id").alias("num_runs"), F.coalesce(X.half_even(F.sum("earned_points")), F.lit(0.0)).alias("total"))


@_query("earned_over_runs", RESULTS, "select question_id, run_id, case when valid_marking then greatest(fine_grained_score, coarse_grained_score) else coarse_grained_score end as earned from r")
def _(r):
    return r.select("question_id", "run_id", scores.earned_over_runs(F.col("fine_grained_score"), F.col("coarse_grained_score"), F.col("valid_marking")).alias("earned"))


@_query("score_rollup", RESULTS, "select dataset, run_id, cast(grouping(dataset) + grouping(run_id) as integer) as level, count(*) as n, round_even(sum(e), 2) as total from s group by rollup (dataset, run_id)", EARNED)
def _(r):
    """The hierarchy of A1, A3 and A5 as one rollup (an addition)."""
    return _results(r).rollup("dataset", "run_id").agg((F.grouping("dataset") + F.grouping("run_id")).cast("int").alias("level"), F.count("*").alias("n"), X.half_even(F.sum("earned_points")).alias("total"))


LAST = ", s as (select *, greatest(fine_grained_score, coarse_grained_score) as e, count(*) over w as repeats from r window w as (partition by dataset, run_id, question_id) qualify row_number() over (partition by dataset, run_id, question_id order by idx desc) = 1)"


@_query("last_of_repeated", REPEATED, "select dataset, question_id, run_id, idx, repeats, e as earned from s", LAST)
def _(r):
    """Q19, over all events."""
    return scores.last_of_repeated(_results(r), ["dataset"]).select("dataset", "question_id", "run_id", "idx", "repeats", F.col("earned_points").alias("earned"))


@_query("dataset_score_of_repeated", REPEATED, "select * from d", LAST + A1_SQL.format(keys="dataset, run_id"))
def _(r):
    """A1 of what Q19 leaves of all events."""
    return scores.dataset_score(scores.last_of_repeated(_results(r), ["dataset"]), ["dataset", "run_id"])


@_query("question_run_pivot_of_repeated", REPEATED, "select question_id, run_id, coalesce(max(e), 0) as earned from (select q.question_id, u.run_id, s.e from (select distinct question_id from r) q cross join (select distinct run_id from r) u left join s on s.question_id = q.question_id and s.run_id = u.run_id) group by question_id, run_id", LAST)
def _(r):
    """A9, J11, Q19 over all events: the runs are the types of events, whose number does not grow with them."""
    runs = _runs(r)
    wide = scores.pivot_runs(scores.last_of_repeated(_results(r), ["dataset"]), runs, ["question_id"], questions=r)
    return wide.unpivot("question_id", runs, "run_id", "earned")


@_query("first_run_questions_of_all", REPEATED, "select q.dataset, q.question_id, q.max_points, count(s.run_id) as num_runs, coalesce(round_even(sum(s.e), 2), 0) as total from (select dataset, question_id, max_by(max_points, idx) as max_points from r join (select dataset, min(run_id) as f from r group by dataset) using (dataset) where run_id = f group by dataset, question_id) q left join s on s.dataset = q.dataset and s.question_id = q.question_id group by all", LAST)
def _(r):
    """J5 over all events: the first run's questions, and their scores in all runs."""
    questions = scores.first_run_questions(r, ["dataset"])
    own = scores.last_of_repeated(_results(r), ["dataset"]).drop("max_points")
    return questions.join(own, ["dataset", "question_id"], "left").groupBy("dataset", "question_id", "max_points").agg(F.count("run_id").alias("num_runs"), F.coalesce(X.half_even(F.sum("earned_points")), F.lit(0.0)).alias("total"))


@_query("run_rank", RESULTS, "select dataset, run_id, row_number() over (partition by dataset order by total_score desc, run_id) as place from d", EARNED + A1_SQL.format(keys="dataset, run_id"))
def _(r):
    from pyspark.sql import Window

    return scores.dataset_score(_results(r), ["dataset", "run_id"]).select("dataset", "run_id", F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("total_score").desc(), "run_id")).alias("place"))


# --- marking

LISTED = ", l as (select p_partkey as id, case p_partkey % 6 when 0 then ['nan', ' '] when 1 then [] when 2 then [null, 'None'] when 3 then [p_brand] when 4 then ['', p_type] else null end as marking from part)"


@_query("valid_marking_filter", None, "with x as (select 1)" + LISTED + " select id, coalesce(len(list_filter(marking, lambda m: m is not null and lower(trim(m)) not in ('', 'nan', 'none', 'null'))) > 0, false) as valid from l")
def _(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.expr("case p_partkey % 6 when 0 then array('nan', ' ') when 1 then array() when 2 then array(null, 'None') when 3 then array(p_brand) when 4 then array('', p_type) end").alias("marking"))
    return r.select("id", P.valid_marking(F.col("marking")).alias("valid"))


@_query("scaled_marking", MARKING, f"select id, set_index, round_even(sum(score), 2) as raw_total, round_even(least(sum(score), {LIMIT}), 2) as score, sum(score) > {LIMIT} as forced from r group by id, set_index")
def _(r):
    return marking.scaled_sums(r.withColumn("score", F.col("score").cast("decimal(18,2)")), ["id", "set_index"], F.lit(LIMIT).cast("decimal(18,2)")).select("id", "set_index", F.col("raw_total").cast("double").alias("raw_total"), F.col("score").cast("double").alias("score"), "forced")


ORACLES["scaled_marking"] = ORACLES["scaled_marking"].replace("sum(score)", "sum(cast(score as decimal(18,2)))").replace(f"{LIMIT}", f"cast({LIMIT} as decimal(18,2))").replace("round_even(sum(cast(score as decimal(18,2))), 2)", "cast(sum(cast(score as decimal(18,2))) as double)").replace(f"round_even(least(sum(cast(score as decimal(18,2))), cast({LIMIT} as decimal(18,2))), 2)", f"cast(least(sum(cast(score as decimal(18,2))), cast({LIMIT} as decimal(18,2))) as double)")


@_query("best_marking_set", MARKING, "select id, case when max(s) > 0 then max(s) else 0 end as score, case when max(s) > 0 then min_by(set_index, struct_pack(a := -s, b := set_index)) + 1 else 0 end as best_marking_set from (select id, set_index, cast(sum(cast(score as decimal(18,2))) as double) as s from r group by id, set_index) group by id")
def _(r):
    sets = r.groupBy("id", "set_index").agg(F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("score"))
    return marking.best_set(sets, ["id"]).na.fill(0, ["best_marking_set"])


@_query("settled_attempts", MARKING, "select id, round_even(case when t > 0.3::double then 0.3::double else t end, 2) as score, t > 0.3::double as forced from (select id, list_reduce(list_prepend(0.0::double, list(score order by criterion_index, tie, score)), lambda a, x: a + x) as t from r group by id)")
def _(r):
    one = r.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("criterion_index", "tie", "score"))).alias("l")).select("id", F.transform("l", lambda x: x["score"]).alias("scores"), F.lit(0.3).alias("max_points"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    settled = marking.settle(one, ["id"])
    return settled.select("id", "score", (~F.col("final_success")).alias("forced"))


# --- answers


def _gold(r: DataFrame):
    return F.array("gold_1", "gold_2"), F.array("points_1", "points_2")


BOX = r"list_filter(list_transform(regexp_extract_all(prediction, '\\boxed\{([^}]+)\}', 1), lambda a: trim(a)), lambda a: a <> '')"
NUM = "[-+]?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?"
SAID = f", a as (select *, list_slice(case when len({BOX}) > 0 then {BOX} else regexp_extract_all(prediction, '{NUM}') end, 1, 2) as said from r)"
NUM_OF = f"try_cast(nullif(regexp_extract({{0}}, '{NUM}'), '') as double)"


def _match_sql(a: str, b: str) -> str:
    x, y = NUM_OF.format(a), NUM_OF.format(b)
    text = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
    return f"case when {x} is not null and {y} is not null then case when {y} = 0 then abs({x} - {y}) < 1e-6 else abs({x} - {y}) / (abs({y}) + 1e-12) < 1e-3 end else {text.format(a)} = {text.format(b)} end"


HIT = "len(list_filter(said, lambda p: {0})) > 0"
HITS = ", h as (select *, " + HIT.format(_match_sql("p", "gold_1")) + " as hit_1, " + HIT.format(_match_sql("p", "gold_2")) + " as hit_2 from a)"


@_query("boxed_extract", SUBMISSIONS, f"select id, array_to_string({BOX}, '|') as boxed, coalesce({BOX}[-1], '') as last_boxed from r")
def _(r):
    return r.select("id", F.array_join(A.boxed(F.col("prediction")), "|").alias("boxed"), A.last_boxed(F.col("prediction")).alias("last_boxed"))


@_query("numeric_fallback", SUBMISSIONS, "select id, array_to_string(said, '|') as said from a", SAID)
def _(r):
    return r.select("id", F.array_join(A.answers(F.col("prediction"), 2), "|").alias("said"))


@_query("grade_numeric", SUBMISSIONS, "select id, hit_1 as hit from h", SAID + HITS)
def _(r):
    return r.select("id", A.hits(F.col("prediction"), F.array("gold_1", "gold_2"))[0].alias("hit"))


@_query("grade_text", SUBMISSIONS, f"select id, {_match_sql('gold_2', chr(39) + 'Brand#1  ' + chr(39))} as same from r")
def _(r):
    return r.select("id", A.matches(F.col("gold_2"), F.lit("Brand#1  ")).alias("same"))


@_query("normalised_text", SUBMISSIONS, r"select id, trim(regexp_replace(lower(concat('  ', prediction, '  X ')), '\s+', ' ', 'g')) as said from r")
def _(r):
    return r.select("id", X.normalise(F.concat(F.lit("  "), F.col("prediction"), F.lit("  X "))).alias("said"))


@_query("earned_points_any", SUBMISSIONS, "select id, (case when hit_1 then points_1 else 0 end + case when hit_2 then points_2 else 0 end) as earned from h", SAID + HITS)
def _(r):
    return r.select("id", A.earned_any(F.col("prediction"), *_gold(r)).alias("earned"))


@_query("earned_points_zip", SUBMISSIONS, f"select id, (case when len(said) >= 1 and {_match_sql('said[1]', 'gold_1')} then points_1 else 0 end + case when len(said) >= 2 and {_match_sql('said[2]', 'gold_2')} then points_2 else 0 end) as earned from a", SAID)
def _(r):
    return r.select("id", A.earned_in_place(F.col("prediction"), *_gold(r)).alias("earned"))


@_query("coarse_or_fine", SUBMISSIONS, "select id, round_even(case when w > 0 then w else fine end, 2) as coarse, round_even(case when w > 0 then w else 0 end, 2) as strict from (select id, fine, (case when hit_1 then points_1 else 0 end + case when hit_2 then points_2 else 0 end) as w from h)", SAID + HITS)
def _(r):
    w = A.earned_any(F.col("prediction"), *_gold(r))
    return r.select("id", A.coarse(w, F.col("fine")).alias("coarse"), A.coarse(w, F.col("fine"), "zero").alias("strict"))


@_query("display_answer", SUBMISSIONS, "select id, array_to_string(said, ', ') as said, list_transform(said, lambda s: concat(chr(92), 'boxed{', s, '}'))[1] as first_made from a", SAID)
def _(r):
    return r.select("id", A.display(F.col("prediction"), 2).alias("said")).withColumn("first_made", A.shown_answers(F.col("said"))[0])


@_query("score_from_response", RESPONSES, r"""select id, round_even(coalesce(
  try_cast(nullif(regexp_extract(response, '\\boxed\{([^}]+)\}', 1), '') as double), try_cast(regexp_extract_all(nullif(regexp_extract(response, '\\boxed\{([^}]+)\}', 1), ''), '[0-9]+[.]?[0-9]*')[-1] as double),
  try_cast(nullif(regexp_extract(response, '(?i)(?:score|final score|total|points?):\s*([0-9]*[.]?[0-9]+)', 1), '') as double), try_cast(nullif(regexp_extract(response, '(?i)([0-9]*[.]?[0-9]+)\s*(?:points?|pts?)', 1), '') as double),
  try_cast(regexp_extract_all(response, '[0-9]*[.]?[0-9]+')[-1] as double), 0), 2) as score from r""")
def _(r):
    return r.select("id", A.score_in(F.col("response")).alias("score"))


# --- fields

F1_SQL = "case when raw is null or raw = '' or raw = 'nan' then [] when raw like '[%]' then coalesce(cast(try_cast(raw as json) as varchar[]), [raw]) else [raw] end"


@_query("parse_json_field", FIELDS, f"select id, cast(len(x) as integer) as n, coalesce(x[1], '') as first from (select id, {F1_SQL} as x from r)")
def _(r):
    return r.select("id", P.json_field(F.col("raw")).alias("x")).select("id", F.size("x").alias("n"), F.coalesce(F.try_element_at("x", F.lit(1)), F.lit("")).alias("first"))


@_query("parse_points", FIELDS, "select id, cast(len(x) as integer) as n, list_sum(x) as total from (select id, case when raw is null then [0.0::double] when raw like '[%]' then coalesce(list_filter(cast(try_cast(raw as json) as double[]), lambda p: p is not null), [0.0::double]) else [coalesce(try_cast(raw as double), 0.0::double)] end as x from (select id, nullif(raw, 'nan') as raw from r))")
def _(r):
    return r.select("id", P.points_field(F.col("raw")).alias("x")).select("id", F.size("x").alias("n"), X.total(F.col("x")).alias("total"))


@_query("coalesce_sample", SAMPLES, "select id, coalesce(nullif(question, ''), nullif(prompt, '')) as question, coalesce(nullif(output, ''), '') as prediction, concat_ws(chr(10), coalesce(coalesce(nullif(question, ''), nullif(prompt, '')), ''), coalesce(context, ''), coalesce(output, '')) as text_all from r")
def _(r):
    q = P.first_said(F.col("question"), F.col("prompt"))
    return r.select("id", q.alias("question"), F.coalesce(P.first_said(F.col("output")), F.lit("")).alias("prediction"), S.full_text(q, F.col("context"), F.col("output")).alias("text_all"))


@_query("shortened_question", SAMPLES, "select id, case when length(prompt) > 100 then concat(left(prompt, 100), '...') else prompt end as question from r")
def _(r):
    return r.select("id", X.shorten(F.col("prompt")).alias("question"))


@_query("run_name", None, "select event_id, concat('run_', cast(event_id % 5 as varchar)) as run from events")
def _(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/events.parquet")
    return r.select("event_id", X.run_name(F.concat(F.lit("file:/x/D/M/run_"), (F.col("event_id") % 5).cast("string"), F.lit(".json"))).alias("run"))


# --- symbols

UNIT_SQL = ", ".join(f"'{u}'" for u in S.UNITS)
OTHER_SQL = ", ".join(f"'{w.lower()}'" for w in S.STOP_WORDS + [w for w in S.LATEX_WORDS if w == w.lower()])
ANSWER_SQL = ", ".join(f"'{w}'" for w in S.ANSWER_WORDS)
QUANTITY_SQL = ", ".join(f"'{w}'" for w in S.QUANTITIES)
SYMBOL_SQL = f"(lower(t) not in ({ANSWER_SQL}) and lower(t) not in ({OTHER_SQL}) and t not in ({UNIT_SQL}) and (t in ({QUANTITY_SQL}) or (not regexp_full_match(t, '[a-z]{{4,}}') and (contains(t, '_') or regexp_matches(t, '[0-9]') or length(t) <= 3))))"
TOKENS = ", tok as (select distinct id, t from (select id, unnest(regexp_extract_all(text_all, '[a-zA-Z][a-zA-Z0-9_]*')) as t from r)), sym as (select id, t as symbol from tok where " + SYMBOL_SQL + ")"
LINES = ", ln as (select id, cast(i - 1 as integer) as line, string_split(text_all, chr(10))[i] as raw from (select id, text_all, unnest(range(1, len(string_split(text_all, chr(10))) + 1)) as i from r))"
FORMULAS = ", fm as (select id, trim(raw) as raw, cast(row_number() over (partition by id order by line) - 1 as integer) as k from ln where regexp_matches(raw, '[A-Za-z0-9_)\\]}]\\s*(=|≈|∝|~)\\s*[-+A-Za-z0-9_(\\[{]') and length(raw) <= 500), fp as (select id, concat('F', lpad(cast(k as varchar), 4, '0')) as fid, raw, '=' as relation, trim(split_part(raw, '=', 1)) as lhs, trim(split_part(raw, '=', 2)) as rhs, k from fm)"


def _parsed(r: DataFrame) -> DataFrame:
    return graph.parsed(graph.spread(r))


@_query("symbol_tokens", SOLUTIONS, "select id, symbol from sym", TOKENS)
def _(r):
    return r.select("id", F.explode(S.symbols(F.col("text_all"))).alias("symbol"))


@_query("plain_symbols", SOLUTIONS, f"select id, t as symbol from tok where lower(t) not in ({ANSWER_SQL}) and t not in ({UNIT_SQL})", TOKENS)
def _(r):
    return r.select("id", F.explode(S.plain_symbols(F.col("text_all"))).alias("symbol"))


ASSIGNED = ", asg as (select id, lower(regexp_extract(x, '^([A-Za-z0-9_]+)', 1)) as name, regexp_extract(x, '([-+]?[0-9.eE+-]+)$', 1) as value from (select id, unnest(regexp_extract_all(text_all, '(?i)\\b[a-z][a-z0-9_]*\\s*=\\s*[-+]?[0-9]+(?:[.][0-9]+)?(?:e[-+]?[0-9]+)?')) as x from r))"


@_query("symbol_frequency", SOLUTIONS, "select id, symbol, cast(count(*) as integer) as frequency from sym join (select id, unnest(regexp_extract_all(text_all, '[A-Za-z0-9_]+')) as w from r) using (id) where w = symbol group by id, symbol", TOKENS)
def _(r):
    return graph.symbol_frequency(_parsed(r)).select("id", "symbol", "frequency")


@_query("symbol_assignments", SOLUTIONS, "select distinct id, symbol, value from sym join asg using (id) where name = lower(symbol)", TOKENS + ASSIGNED)
def _(r):
    return graph.symbol_frequency(_parsed(r)).select("id", "symbol", F.explode("assigned_values").alias("value"))


@_query("formula_parse", SOLUTIONS, "select id, fid, raw, relation, lhs, rhs, k as line_index from fp", LINES + FORMULAS)
def _(r):
    return graph.formula_rows(_parsed(r)).select("id", "fid", "raw", "relation", "lhs", "rhs", "line_index")


USES = ", us as (select distinct id, fid, t as symbol from (select id, fid, unnest(regexp_extract_all(raw, '[a-zA-Z][a-zA-Z0-9_]*')) as t from fp) where " + SYMBOL_SQL.replace(f"lower(t) not in ({ANSWER_SQL}) and ", "") + "), df as (select id, fid, regexp_extract(lhs, '([A-Za-z][A-Za-z0-9_]*)', 1) as symbol, rhs, raw, k from fp)"


@_query("formula_uses_edges", SOLUTIONS, "select id, fid, symbol, 'uses' as role from us union all select df.id, df.fid, df.symbol, 'defines' from df join us on us.id = df.id and us.fid = df.fid and us.symbol = df.symbol", LINES + FORMULAS + USES)
def _(r):
    return graph.uses(graph.formula_rows(_parsed(r))).select("id", "fid", "symbol", "role")


OCCURS = ", oc as (select ln.id, symbol, line, concat_ws(' ', lag(trim(raw)) over w, trim(raw), lead(trim(raw)) over w) as context, raw from ln join sym using (id) window w as (partition by ln.id, symbol order by line)), oo as (select id, symbol, line, context from oc where list_contains(regexp_extract_all(raw, '[A-Za-z0-9_]+'), symbol))"


@_query("context_window", SOLUTIONS, "select * from oo", TOKENS + LINES + OCCURS)
def _(r):
    return graph.occurrences(_parsed(r))


CUE_SQL = ", ".join(f"'{c}'" for c in S.CUES)


@_query("precondition_cues", SOLUTIONS, f"select id, c as cue from (select id, text_all, unnest([{CUE_SQL}]) as c from r) where contains(text_all, c) or contains(lower(text_all), c)")
def _(r):
    return r.select("id", F.explode(S.cues(F.col("text_all"))).alias("cue"))


# --- rules

SELF_SQL = "select df.id, df.symbol from df join us on us.id = df.id and us.fid = df.fid and us.symbol = df.symbol where (select count(*) from us u where u.id = df.id and u.fid = df.fid) > 1"


@_query("rule_self_reference", SOLUTIONS, f"select id, symbol, count(*) as n from ({SELF_SQL}) group by id, symbol", LINES + FORMULAS + USES)
def _(r):
    rows = _parsed(r).select("id", F.explode(rules.self_reference(F.col("formulas"))).alias("d"))
    return rows.groupBy("id", F.col("d.symbol").alias("symbol")).agg(F.count("*").alias("n"))


SHARED = r"select id, concat(text_all, chr(10), 'q1 = u0 + w2', chr(10), 'q2 = u0 * 3', chr(10), 'q3 = q3 * u0') as text_all from (" + SOLUTIONS + ") z"


@_query("rule_undefined_symbol", SHARED, "select x.id, x.symbol from (select id, symbol from us group by id, symbol having count(*) >= 2) x join (select id, symbol from oo group by id, symbol having count(*) >= 2) y on x.id = y.id and x.symbol = y.symbol left join (select distinct df.id, df.symbol from df join us u on u.id = df.id and u.fid = df.fid and u.symbol = df.symbol) z on z.id = x.id and z.symbol = x.symbol where (length(x.symbol) <= 3 or contains(x.symbol, '_')) and z.id is null", TOKENS + LINES + FORMULAS + USES + OCCURS)
def _(r):
    rows = _parsed(r).select("id", F.explode(rules.undefined_symbol(F.col("text_all"), F.col("symbols"), F.col("formulas"))).alias("d"))
    return rows.select("id", F.col("d.symbol").alias("symbol"))


@_query("rule_conflicting_definition", SOLUTIONS, "select id, symbol, cast(count(distinct rhs) as integer) as variants from df group by id, symbol having count(distinct rhs) >= 2", LINES + FORMULAS + USES)
def _(r):
    rows = _parsed(r).select("id", F.explode(rules.conflicting_definition(F.col("formulas"))).alias("d"))
    return rows.select("id", F.col("d.symbol").alias("symbol"), F.size(F.from_json("d.evidence", "struct<rhs_variants:array<string>>")["rhs_variants"]).alias("variants"))


@_query("diagnostics_score", SOLUTIONS, f"select count(*) as num_samples, sum(s) as total_score, avg(s) as avg_score from (select r.id, -0.5::double * (select count(*) from (select distinct symbol from ({SELF_SQL}) d where d.id = r.id)) - 0.5::double * (select count(*) from (select symbol from df where df.id = r.id group by symbol having count(distinct rhs) >= 2)) as s from r)", LINES + FORMULAS + USES)
def _(r):
    found = rules.dedupe(rules.graph_consistency(F.col("text_all"), F.col("symbols"), F.col("formulas")))
    return rules.summary(_parsed(r).select("id", rules.score(found).alias("score")))


@_query("diagnostics_dedupe", None, "select user_id, event_type as rule, symbol, event_id from (select *, case event_id % 3 when 1 then 'a' when 2 then 'b' end as symbol, row_number() over (partition by user_id, event_type, case event_id % 3 when 1 then 'a' when 2 then 'b' end order by ts, event_id) as n from events) where n = 1")
def _(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"rule": F.col("event_type"), "symbol": F.expr("case event_id % 3 when 1 then 'a' when 2 then 'b' end"), "message": F.lit("m")})
    return rules.dedupe_rows(r, ["user_id"], ["ts", "event_id"]).select("user_id", "rule", "symbol", "event_id")


# --- catalog, cache, budget


@_query("catalog_pending", None, "select d.n_name as dataset, m.c_mktsegment as model from nation d cross join (select distinct c_mktsegment from customer) m where exists (select 1 from customer c where c.c_nationkey = d.n_nationkey and c.c_mktsegment = m.c_mktsegment and c.c_acctbal > 0) and not exists (select 1 from customer c join orders o on o.o_custkey = c.c_custkey where c.c_nationkey = d.n_nationkey and c.c_mktsegment = m.c_mktsegment and o.o_totalprice > 490000)")
def _(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("model"))
    known = read("nation").select(F.col("n_name").alias("dataset")).crossJoin(read("customer").select(F.col("c_mktsegment").alias("model")).distinct())
    done = customers.join(read("orders").filter("o_totalprice > 490000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return catalog.pending(known, customers.filter("c_acctbal > 0"), done)


@_query("multi_run_datasets", RESULTS, "select dataset, question_id as model, count(distinct run_id) as num_runs from r where valid_marking group by all having count(distinct run_id) > 1")
def _(r):
    return catalog.multi_run(r.filter("valid_marking").withColumn("model", F.col("question_id")))


@_query("cache_lookup", None, "select p_partkey as id, sha256(p_name) as key, c.p_brand as value from part p left join (select sha256(p_name) as k, min(p_brand) as p_brand from part where p_size > 25 group by 1) c on c.k = sha256(p.p_name)")
def _(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/part.parquet").withColumns({"namespace": F.lit("rule"), "key": F.sha2("p_name", 256)})
    cache = r.filter("p_size > 25").groupBy("namespace", "key").agg(F.min("p_brand").alias("value"))
    return judge.lookup(r.select("namespace", "key", F.col("p_partkey").alias("id")), cache).select("id", "key", "value")


@_query("budget_rank", None, "select p_partkey as id, row_number() over (order by p_partkey) as call_rank from part")
def _(spark, sf_dir):
    """X3."""
    return judge.budget_rank(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id")), ["id"])


@_query("reply_diagnostics", None, """select p_partkey as id, case p_partkey % 3 when 0 then 'error' when 1 then 'info' else 'warning' end as severity, p_brand as symbol, concat('m ', p_type) as message from part""")
def _(spark, sf_dir):
    reply = F.concat(F.lit('Here: [{"severity": "'), F.expr("case p_partkey % 3 when 0 then 'ERROR' when 1 then 'grave' else 'warning' end"), F.lit('", "symbol": "'), F.col("p_brand"), F.lit('", "detail": "m '), F.col("p_type"), F.lit('"}, 7] end'))
    r = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.explode(P.diagnostics_in(P.json_in_text(reply), F.lit("x"))).alias("d"))
    return r.select("id", "d.severity", "d.symbol", "d.message")


# --- further rows of the inventory


KIND_SQL = ", ".join(f"{k}_grained_{a} as {k}_grained_{b}" for k in ("fine", "coarse") for a, b in (("total_score", "score"), ("score_rate", "rate")))


@_query("summary_tables", RESULTS, f"select dataset as dataset_key, total_count as total_questions, total_score, max_possible_score, score_rate, total_count, {KIND_SQL} from d where total_count > 0", EARNED + A1_SQL.format(keys="dataset"))
def _(r):
    """P13, W2, K6."""
    return sinks.summary_table(scores.dataset_score(_results(r), ["dataset"]).withColumnRenamed("dataset", "dataset_key"))


@_query("run_tables", RESULTS, f"select run_id, total_score, max_possible_score, score_rate, total_count, {KIND_SQL} from d", EARNED + A1_SQL.format(keys="run_id"))
def _(r):
    """P15, K11."""
    return sinks.run_table(scores.dataset_score(_results(r), ["run_id"]))


@_query("multi_run_tables", RESULTS, "select dataset as dataset_key, num_runs, num_questions, mean_total_score, std_total_score, mean_score_rate, std_score_rate, question_based_mean_score, question_based_max_score, question_based_score_rate from (select dataset, count(*) as num_runs, round_even(avg(total_score), 2) as mean_total_score, round_even(stddev_pop(total_score), 2) as std_total_score, round_even(avg(score_rate), 2) as mean_score_rate, round_even(stddev_pop(score_rate), 2) as std_score_rate from d group by dataset) join (select dataset, count(*) as num_questions, round_even(sum(mean_score), 2) as question_based_mean_score, round_even(sum(max_points), 2) as question_based_max_score, round_even(sum(mean_score) / sum(max_points) * 100, 2) as question_based_score_rate from q group by dataset) using (dataset)", EARNED + A1_SQL.format(keys="dataset, run_id") + QUESTIONS_SQL)
def _(r):
    """P14, K13."""
    rows = _results(r)
    stats = scores.question_stats(rows, ["dataset", "question_id", "max_points"])
    return sinks.multi_run_table(scores.overall_stats(rows, stats, ["dataset"]).withColumnRenamed("dataset", "dataset_key"))


@_query("failed_problems", RESULTS, "select dataset, count(*) as total_count, round_even(coalesce(sum(case when valid_marking then max_points end), 0), 2) as max_possible_score from r group by dataset")
def _(r):
    """W1 within A1: failed problems count, but give no points."""
    rows = _results(r).withColumn("error", F.when(~F.col("valid_marking"), "failed"))
    return scores.dataset_score(rows, ["dataset"], stepwise=False).select("dataset", "total_count", "max_possible_score")


@_query("dataset_runs", RESULTS, "select dataset, array_to_string(list(distinct run_id order by run_id), ',') as runs from r group by dataset")
def _(r):
    """S5."""
    return catalog.runs(r.withColumn("model", F.lit("m"))).select("dataset", F.array_join("runs", ",").alias("runs"))


@_query("succeeded_count", RESULTS, "select count(*) filter (valid_marking) as succeeded, count(*) as total from r")
def _(r):
    """A21."""
    return catalog.succeeded(r.withColumn("error", F.when(~F.col("valid_marking"), "failed")))


@_query("shown_and_plain_answers", SUBMISSIONS, "select id, array_to_string(list_transform(said, lambda a: concat(chr(92), 'boxed{', a, '}')), ' ') as shown, array_to_string(said, ', ') as plain from a", SAID)
def _(r):
    """P11, P12."""
    shown = A.shown_answers(A.display(F.col("prediction"), 2))
    return r.select("id", F.array_join(shown, " ").alias("shown"), A.plain_answers(shown).alias("plain"))


@_query("marking_sets", None, "select p_partkey as id, cast(case p_partkey % 4 when 0 then 1 when 1 then 2 when 2 then 0 else 1 end as integer) as sets, cast(case p_partkey % 4 when 0 then 2 when 1 then 3 when 2 then 0 else 1 end as integer) as criteria, p_partkey % 4 in (0, 1) as valid from part")
def _(spark, sf_dir):
    """W3, W4, F3 on variants: flat lists, lists of lists, none, and text."""
    q = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    kind = F.col("p_partkey") % 4
    j = F.when(kind == 0, F.concat(F.lit("["), q("p_brand"), F.lit(', " ", '), q("p_type"), F.lit("]"))).when(kind == 1, F.concat(F.lit("[["), q("p_brand"), F.lit("], ["), q("p_type"), F.lit(", null, "), q("p_name"), F.lit("]]"))).when(kind == 2, F.lit("null")).otherwise(q("p_type"))
    r = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.parse_json(j).alias("v"))
    sets = P.marking_sets(F.col("v"))
    return r.select("id", F.size(sets).alias("sets"), F.size(F.flatten(F.transform(sets, P.criteria))).alias("criteria"), P.valid_marking_variant(F.col("v")).alias("valid"))


@_query("formula_line_filters", SOLUTIONS, "select id, cast(count(*) filter (regexp_matches(raw, '[A-Za-z0-9_)\\]}]\\s*(=|≈|∝|~)\\s*[-+A-Za-z0-9_(\\[{]')) as integer) as likely, cast(count(*) filter (regexp_matches(raw, '[=≈~∝]')) as integer) as plain from ln group by id", LINES)
def _(r):
    """W9, W10."""
    return r.select("id", F.size(S.formula_lines(F.col("text_all"))).alias("likely"), F.size(S.plain_formula_lines(F.col("text_all"))).alias("plain"))


@_query("symbol_nodes", SOLUTIONS, "select id, symbol, cast(max(u) as integer) as used, cast(max(o) as integer) as seen from (select id, symbol, count(*) as u, 0 as o from us group by id, symbol union all select id, symbol, 0, count(*) from oo group by id, symbol) group by id, symbol", TOKENS + LINES + FORMULAS + USES + OCCURS)
def _(r):
    """A20, D10."""
    return graph.nodes(_parsed(r)).select("id", "symbol", F.size("used_in").alias("used"), F.size("occurrences").alias("seen"))


@_query("strict_self_reference", SHARED, "select df.id, df.symbol from df join us on us.id = df.id and us.fid = df.fid and us.symbol = df.symbol where (select count(*) from us u where u.id = df.id and u.fid = df.fid) > 1 and list_contains(regexp_extract_all(df.rhs, '[A-Za-z0-9_]+'), df.symbol)", LINES + FORMULAS + USES)
def _(r):
    """R1 in its strict form (Q8)."""
    rows = _parsed(r).select("id", F.explode(rules.self_reference(F.col("formulas"), "strict", True)).alias("d"))
    return rows.select("id", F.col("d.symbol").alias("symbol"))


@_query("penalties", None, "select event_type, sum(case event_type when 'error' then -1.0::double when 'click' then -0.5::double else 0 end) as score from events group by event_type")
def _(spark, sf_dir):
    """A13 on one row a diagnostic."""
    r = spark.read.parquet(f"{sf_dir}/events.parquet")
    severity = F.when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type"))
    return r.groupBy("event_type").agg(F.sum(rules.penalty(severity)).alias("score"))


@_query("sample_meta", SAMPLES, "select id, concat(coalesce(prompt, ''), '|', coalesce(context, ''), '|', coalesce(output, '')) as said, 'extra=7' as meta from r")
def _(r):
    """P5, U3 on a JSON record: aliases by name, the rest as meta."""
    j = F.to_json(F.struct(F.col("id").cast("string").alias("problem_id"), "prompt", F.col("context").alias("passage"), "output", F.lit(7).alias("extra")))
    files = r.select("id", F.lit("f").alias("path"), F.lit("d").alias("dataset"), F.lit("m").alias("model"), F.lit("r").alias("run_id"), F.lit(True).alias("readable"), F.array(F.parse_json(j)).alias("items"))
    x = inference.samples(files)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return x.select(F.col("id").cast("long").alias("id"), F.concat_ws("|", blank("question"), blank("context"), blank("prediction")).alias("said"), F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("meta"))


# --- readers, on JSON made of the tables


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are problems; their size and brand tell the dataset and the model, of one run each."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.col("p_partkey") % 5
    box = F.concat(F.lit("so \\boxed{"), F.col("p_size").cast("string"), F.lit("}"))
    fields = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.when(kind == 4, None).otherwise(box).alias("prediction"),
        F.when(kind == 0, F.to_json(F.array(F.col("p_size").cast("string"), F.lit("7")))).when(kind == 3, None).otherwise(F.col("p_size").cast("string")).alias("answer"),
        F.when(kind == 1, F.lit("[2, 1]")).when(kind == 2, F.lit("3")).alias("points"),
        F.when(kind == 1, F.array(F.lit("nan"))).when(kind == 2, F.array("p_type")).alias("marking"),
    )
    rows = part.groupBy(F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string")).alias("dataset"), F.col("p_brand").alias("model")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(fields).alias("j")))).alias("l"))
    return rows.select(F.concat_ws("/", "dataset", "model").alias("path"), "dataset", "model", F.lit("r1").alias("run_id"), F.lit(True).alias("readable"), F.transform("l", lambda x: F.parse_json(x["j"])).alias("items"))


READ_SQL = ", x as (select concat('m', cast(p_size % 4 as varchar)) as dataset, p_brand as model, row_number() over (partition by p_size % 4, p_brand order by p_partkey) - 1 as idx, p_partkey, p_partkey % 5 as kind, p_name, p_type, cast(p_size as varchar) as size from part)"


@_query("problem_rows", None, "with y as (select 1)" + READ_SQL + " select concat(dataset, '/', model) as path, cast(idx as integer) as idx, cast(p_partkey as varchar) as question_id, p_name as question, case when kind <> 4 then concat('so ', chr(92), 'boxed{', size, '}') end as prediction, case kind when 0 then concat(size, '|7') when 3 then '' else size end as answer, case kind when 1 then 3.0::double when 2 then 3.0::double else 0.0::double end as points, kind = 2 as valid_marking, case kind when 4 then 'no prediction' when 3 then 'no answer' else '' end as error from x")
def _(spark, sf_dir):
    """The fields of each problem as they are normalised."""
    return inference.problems(_files(spark, sf_dir)).select("path", "idx", "question_id", "question", "prediction", F.array_join("answer", "|").alias("answer"), X.total(F.col("points")).alias("points"), "valid_marking", F.coalesce("error", F.lit("")).alias("error"))


@_query("scored_problems", None, "with y as (select 1)" + READ_SQL + " select concat(dataset, '/', model) as source, cast(p_partkey as varchar) as id, case kind when 1 then 2.0::double when 2 then 3.0::double else 0.0::double end as coarse_grained_score, case kind when 1 then 2.0::double when 2 then 3.0::double else 0.0::double end as earned_points, 0.0::double as fine_grained_score, concat(chr(92), 'boxed{', size, '}') as shown, case when kind = 0 then 2 else 1 end as answers, 'text' as modality, 'Open-End' as answer_type from x where kind not in (3, 4)")
def _(spark, sf_dir):
    """M5, P3, K3 without a judge: scores of each problem and the detailed columns."""
    found = sinks.detailed(evaluate.score_problems(inference.problems(_files(spark, sf_dir))))
    return found.select("source", "id", "coarse_grained_score", "earned_points", "fine_grained_score", F.array_join("test_answer", " ").alias("shown"), F.size("answer").alias("answers"), "modality", F.array_join("answer_type", "|").alias("answer_type"))


@_query("newest_files", None, "select cast(user_id as varchar) as model, event_id from (select *, row_number() over (partition by user_id order by ts desc, cast(event_id as varchar) desc) as n from events) where n = 1")
def _(spark, sf_dir):
    """Each event a file."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("model"), "event_id", F.col("ts").alias("modified"), F.col("event_id").cast("string").alias("path"))
    return inference.newest(files, ["model"]).select("model", "event_id")


@_query("fine_or_zero", None, "select p_partkey as id, case when p_partkey % 3 <> 0 and p_partkey % 2 = 0 then coalesce(case when p_size > 10 then p_size / 10.0::double end, 0.0::double) else 0.0::double end as fine from part")
def _(spark, sf_dir):
    """W5."""
    r = spark.read.parquet(f"{sf_dir}/part.parquet")
    return r.select(F.col("p_partkey").alias("id"), marking.fine_score(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 2 == 0, F.when(F.col("p_size") > 10, F.col("p_size") / F.lit(10.0))).alias("fine"))


@_query("malformed_replies", None, "select p_partkey as id, cast(case p_partkey % 6 when 3 then 1 when 4 then 1 else 0 end as integer) as n, case p_partkey % 6 when 3 then 'info' when 4 then 'warning' else '' end as severity from part")
def _(spark, sf_dir):
    """Replies that are no JSON, an object, a list of other things, a list within text, and none at all."""
    reply = F.expr("""case p_partkey % 6 when 0 then concat('I find nothing in ', p_name) when 1 then '{"severity": "error"}' when 2 then '[1, "x", null]'
     when 3 then concat('Here: [{"symbol": "', p_brand, '"}, 3] end') when 4 then '[{"severity": "WARNING", "message": ""}]' end""")
    found = P.diagnostics_in(P.json_in_text(reply), F.lit("x"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), found.alias("d")).select("id", F.size("d").alias("n"), F.coalesce(F.get("d", F.lit(0))["severity"], F.lit("")).alias("severity"))


@_query("cache_keys", None, """select p_partkey as id, sha256(concat('{"inputs":"', p_name, '","model":"', p_brand, '","rule":"r"}')) as key from part""")
def _(spark, sf_dir):
    """the payload's names are sorted, whatever their order."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), P.cache_key(F.lit("r").alias("rule"), F.col("p_name").alias("inputs"), F.col("p_brand").alias("model")).alias("key"))


@_query("line_breaks", None, "select p_partkey as id, case when p_partkey % 2 = 0 then concat(p_name, '|', p_brand, '||', p_type) else concat(p_name, '|', p_type) end as said from part")
def _(spark, sf_dir):
    """all sorts of line breaks; one at the end opens no further line."""
    text = F.expr("case when p_partkey % 2 = 0 then concat(p_name, '\\r\\n', p_brand, '\\n', '\\n', p_type, '\\r') else concat(p_name, '\\r', p_type, '\\n') end")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.array_join(X.lines(text), "|").alias("said"))


#: The 100 first different texts are asked about.
CHECKED = ", b as (select r.id, t.n <= 100 as asked from r join (select text_all, row_number() over (order by min(cast(id as varchar))) as n from r group by text_all) t on t.text_all = r.text_all)"


def _samples(r: DataFrame) -> DataFrame:
    return graph.spread(r).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("context"), F.col("text_all").alias("prediction"))


@_query("verify_by_rules", SOLUTIONS, f"select cast(r.id as varchar) as id, -0.5::double * (select count(*) from (select distinct symbol from ({SELF_SQL}) d where d.id = r.id)) - 0.5::double * (select count(*) from (select symbol from df where df.id = r.id group by symbol having count(distinct rhs) >= 2)) - case when b.asked then 2.0::double else 0.0::double end as score from r join b on b.id = r.id", LINES + FORMULAS + USES + CHECKED)
def _(r):
    """A native rule, two that ask a model and share 200 calls, and one that is not there."""
    reply = '[{"severity": "error", "rule": "x", "symbol": null, "message": "wrong"}]'
    cache = r.sparkSession.createDataFrame([], "namespace string, key string, value string")
    report, _ = verify.by_rules(_samples(r), ["graph_consistency", "formula_correctness", "precondition_consistency", "no.such.rule"], cache, lambda: judge.ScriptedClient(lambda p: reply), "m", 200)
    return sinks.light(report).select("id", "score")


@_query("verify_by_model", SOLUTIONS, "select cast(b.id as varchar) as id, case when b.asked then -0.5::double else 0.0::double end as score, case when b.asked then 'told' else '' end as said from b", CHECKED)
def _(r):
    """One call a different text, for 100 of them; the reply's symbols join the text's."""
    reply = '{"diagnostics": [{"severity": "warning", "message": "m"}], "symbols": {"k_B": "told"}}'
    cache = r.sparkSession.createDataFrame([], "namespace string, key string, value string")
    report, _ = verify.by_model(_samples(r), cache, lambda: judge.ScriptedClient(lambda p: reply), "m", 100)
    return report.select("id", "score", F.coalesce(F.try_element_at("symbol_nodes", F.lit("k_B")), F.lit("")).alias("said"))



# --- stages that call Python


@_query("judge_stub", SUBMISSIONS, "select cast(id as varchar) as problem_key, 0 as set_index, case when id % 10 = 0 then 1.0::double else 0.8::double end as score, case when id % 10 = 0 then '0.67,0.33' else '0.4,0.4' end as scores, case when id % 10 = 0 then 4 else 1 end as attempt, case when id % 10 = 0 then 0.833::double else 0.0::double end as scale_factor, id % 10 <> 0 as final_success from r")
def _(r):
    """Two criteria a problem, judged by a scripted client; the scores of a tenth are over the limit at each attempt."""
    problems = r.select(F.col("id").cast("string").alias("problem_key"), F.lit("q").alias("question"), "prediction", F.array(F.array(F.lit("units"), F.lit("value"))).alias("sets"), F.lit(1.0).alias("max_points"))
    found = judge.judge_criteria(problems, lambda: judge.ScriptedClient(lambda p: "\\boxed{0.8}" if "units" in p and "speed" in p else "\\boxed{0.4}"))
    scores_ = F.array_join(F.transform("scores", lambda s: s.cast("string")), ",")
    return found.select("problem_key", "set_index", "score", scores_.alias("scores"), "attempt", F.coalesce("scale_factor", F.lit(0.0)).alias("scale_factor"), "final_success")


class LongLine:
    """A user's rule, as an example: lines of more than 30 characters."""

    id, title, description = "long_line", "Long lines", "Lines of more than 30 characters"

    def run(self, context, runtime):
        return [{"severity": "info", "symbol": None, "message": "long line", "evidence": x} for x in context.text_all.split("\n") if len(x) > 30]


@_query("rule_plugin", SOLUTIONS, "select id, cast(len(list_filter(string_split(text_all, chr(10)), lambda x: length(x) > 30)) as integer) as n from r")
def _(r):
    """X4."""
    rows = _parsed(r).withColumn("dataset", F.lit("d"))
    found = rules.diagnostic_rows(rows, [LongLine()], outer=True)
    return found.groupBy("id").agg(F.count("message").cast("int").alias("n"))


class NoIdealGas:
    """A user's rule that fails where a text assumes an ideal gas, with a column of its own."""

    id, columns = "no_ideal_gas", {"lines": "int"}

    def run(self, context, runtime):
        if "Ideal Gas" in context.text_all:
            raise ValueError("an ideal gas")
        return [{"message": "real", "lines": context.text_all.count("\n") + 1}]


@_query("rule_failures", SOLUTIONS, "select id, cast(case when id % 2 = 1 then 4 end as integer) as lines, case when id % 2 = 0 then 'ValueError: an ideal gas' else '' end as error from r")
def _(r):
    """A rule that raises gives a row with its error, and the others go on."""
    rows = rules.diagnostic_rows(_parsed(r), [NoIdealGas()])
    return rows.select("id", "lines", F.coalesce("rule_error", F.lit("")).alias("error"))
