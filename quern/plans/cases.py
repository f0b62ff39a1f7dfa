"""Queries that answer from cases: neighbours, their programs, statistics by cluster, execution and ranks. Clusters are the entities' types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tables import materialize
from quern.operators import cases as cs
from quern.operators import evaluate as ev
from quern.operators import paths as pt
from quern.operators import ranking as rk
from quern.operators import similarity as sm
from quern.plans.queries import _FOUND, _MRR, _SIGS, _found, _kind, part, query

#: Successors of a step when precision is counted and when queries are answered, and executable programs of a query, in the queries that show these limits; low, so that each of them binds in the tables. Answers and their metrics have none of them.
COUNTED, ANSWERED, MOST = 2, 3, 4

_NEAR = f"""{_SIGS}, q as (select distinct h, r from test), have as (select distinct h as e, r from train),
    lead_ as (select * from (select have.r, have.e, sig, row_number() over (partition by sig, have.r order by have.e) as i from have join sigs using (e)) where i <= 6),
    short as (select * from (select a.sig as a, a.r, l.e, sim, row_number() over (partition by a.sig, a.r order by round(sim, 9) desc, l.e) as i from (select distinct sig, r from q join sigs on sigs.e = q.h) a join sim on sim.a = a.sig join lead_ l on l.sig = sim.b and l.r = a.r) where i <= 6),
    near as (select * from (select q.h, q.r, short.e, round(sim, 6) as sim, row_number() over (partition by q.h, q.r order by round(sim, 9) desc, short.e) as place from q join sigs x on x.e = q.h join short on short.a = x.sig and short.r = q.r where short.e != q.h) where place <= 5)"""


def _capped(name: str, most: int | None) -> str:
    return f"{name} as (select h, r, t from train)" if most is None else f"{name} as (select h, r, t from (select *, row_number() over (partition by h, r order by md5('0|' || h || '|' || r || '|' || t)) as k from train) where k <= {most})"


_POOL = "pool as (select near.h, near.r, program, cast(sum(n) as bigint) as n from near join found on found.h = near.e and found.r = near.r group by 1, 2, 3)"
_TWO = "select {s}.h, {s}.r, {s}.program, coalesce(b.t, a.t) as \"end\", count(*) as n from (select *, split_part(program, '/', 1) as s1, nullif(split_part(program, '/', 2), '') as s2 from {s}) {s} join {e} a on a.h = {s}.h and a.r = s1 left join {e} b on b.h = a.t and b.r = s2 where s2 is null or b.t is not null group by 1, 2, 3, 4"


def _values(counted: int | None) -> str:
    return f"""{_capped('counted', counted)}, tries as (select distinct t.h, t.r, p.program from (select distinct h, r from train) t join (select distinct r, program from found) p using (r)),
    tried as ({_TWO.format(s='tries', e='counted')}), hit as (select tried.*, regexp_replace(tried.h, '[0-9]+', '', 'g') as c, case when a.t is not null then n else 0 end as good from tried left join train a on a.h = tried.h and a.r = tried.r and a.t = tried."end"),
    prec as (select r, program, sum(good) / sum(n) as precision from hit group by 1, 2), cprec as (select c, r, program, sum(good) / sum(n) as precision from hit group by 1, 2, 3),
    prior as (select r, program, sum(n) / sum(sum(n)) over (partition by r) as prior from found group by r, program),
    cprior as (select c, r, program, sum(n) / sum(sum(n)) over (partition by c, r) as prior from (select *, regexp_replace(h, '[0-9]+', '', 'g') as c from found) group by 1, 2, 3),
    value as (select r, program, prior * precision as score from prior join prec using (r, program)), cvalue as (select c, r, program, prior * precision as score from cprior join cprec using (c, r, program))"""


def _run(answered: int | None, most: int | None) -> str:
    first = "" if most is None else f" where nth <= {most}"
    return f"""{_capped('answered', answered)}, allends as ({_TWO.format(s='ranked', e='answered')}),
    chosen as (select * from (select x.h, x.r, x.program, score, row_number() over (partition by x.h, x.r order by place) as nth from (select distinct h, r, program from allends) x join ranked using (h, r, program)){first}),
    ends as (select h, r, program, "end", n, score, nth from allends join chosen using (h, r, program))"""


_VALUES, _RUN = _values(COUNTED), _run(ANSWERED, MOST)
_RANKED = """scored as (select pool.h, pool.r, pool.program, coalesce(cvalue.score, value.score, 0) as score from pool left join cvalue on cvalue.c = regexp_replace(pool.h, '[0-9]+', '', 'g') and cvalue.r = pool.r and cvalue.program = pool.program left join value on value.r = pool.r and value.program = pool.program where pool.program != pool.r),
    ranked as (select *, row_number() over (partition by h, r order by round(score, 12) desc, program) as place from scored)"""
_ANSWER = "answer as (select h, r, e, round(sum(score), 9) as score from (select distinct h, r, \"end\" as e, program, score from ends) group by 1, 2, 3)"
_ALL = f"{_NEAR}, {_FOUND}, {_POOL}, {_VALUES}, {_RANKED}, {_RUN}, {_ANSWER}"
_WHOLE = f"{_NEAR}, {_FOUND}, {_POOL}, {_values(None)}, {_RANKED}, {_run(None, None)}, {_ANSWER}"
_JUDGED = """known as (select a.*, k.h is not null as known from answer a left join edges k on k.h = a.h and k.r = a.r and k.t = a.e),
    placed as (select h, r, e, known, sum(case when known then 0 else 1 end) over (partition by h, r order by score desc, e rows unbounded preceding) - case when known then 0 else 1 end + 1 as rank from known),
    judged as (select t.h, t.r, t.t, rank from test t left join placed p on p.h = t.h and p.r = t.r and p.e = t.t)"""


class _Parts:
    """The steps of answering all test queries over the typed test graph. limited: by COUNTED, ANSWERED and MOST, else with all walks of all programs."""

    def __init__(self, spark, d, limited: bool = True):
        self.counted, self.answered, self.most = (COUNTED, ANSWERED, MOST) if limited else (None, None, None)
        self.train, self.test = part(spark, d, typed=True), part(spark, d, "test", typed=True)
        self.edges = part(spark, d, None, typed=True)

    def near(self) -> DataFrame:
        return materialize(sm.neighbours(self.test, self.train), "near")

    def found(self) -> DataFrame:
        return _found(self.train)

    def ranked(self, pool: DataFrame, found: DataFrame) -> DataFrame:
        clusters = self.train.select(F.col("h").alias("e")).union(self.test.select("h")).distinct().withColumn("c", _kind("e"))
        return cs.ranked_programs(pool, cs.statistics(found, self.train, clusters, self.counted))

    def ends(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        near, found = self.near(), self.found()
        ranked = self.ranked(cs.program_pool(near, found), found)
        return near, ranked, cs.executed(ranked, self.train, self.most, self.answered, self.test)

    def answers(self) -> DataFrame:
        return cs.answers(self.ends()[2]).withColumn("score", F.round("score", 9))

    def judged(self, answers: DataFrame) -> DataFrame:
        """Each test fact with its rank in the list of answers, without the other known ones; null if it isn't there."""
        known = self.edges.select("h", "r", F.col("t").alias("e"), F.lit(True).alias("known"))
        rows = answers.join(known, ["h", "r", "e"], "left").select(F.concat_ws("|", "h", "r").alias("q"), "h", "r", "e", "score", F.coalesce("known", F.lit(False)).alias("known"))
        ranks = rk.among(rows).select("h", "r", F.col("e").alias("t"), F.col("place").alias("rank"))
        return self.test.join(ranks, ["h", "r", "t"], "left")


@query("r08_neighbours", f"with {_NEAR} select h, r, e, sim, place from near", typed=True)
def r08(spark, d):
    return _Parts(spark, d).near().select("h", "r", "e", F.round("sim", 6).alias("sim"), F.col("place").cast("long").alias("place"))


@query("g08_program_pool", f"with {_NEAR}, {_FOUND}, {_POOL} select * from pool", typed=True)
def g08(spark, d):
    p = _Parts(spark, d)
    return cs.program_pool(p.near(), p.found())


@query("j10_score_fallback", f"with {_FOUND}, {_VALUES} select x.c, r, program, round(coalesce(cvalue.score, value.score, 0), 6) as score from (select r, program, unnest(['c', 's', 'z']) as c from (select distinct r, program from found)) x left join cvalue using (c, r, program) left join value using (r, program)", typed=True)
def j10_scores(spark, d):
    p = _Parts(spark, d)
    found = p.found()
    s = cs.statistics(found, p.train, p.train.select(F.col("h").alias("e")).distinct().withColumn("c", _kind("e")), COUNTED)
    pairs = found.select("r", "program").distinct().withColumn("c", F.explode(F.array(*map(F.lit, "csz"))))
    return pt.with_fallback(pairs, s.by_cluster, s.overall, "score").select("c", "r", "program", F.round("score", 6).alias("score"))


@query("r06_ranked_programs", f"with {_NEAR}, {_FOUND}, {_POOL}, {_VALUES}, {_RANKED} select h, r, program, round(score, 6) as score, place from ranked", typed=True)
def r06(spark, d):
    p = _Parts(spark, d)
    found = p.found()
    return p.ranked(cs.program_pool(p.near(), found), found).select("h", "r", "program", F.round("score", 6).alias("score"), "place")


@query("r07_executable_programs", f"with {_NEAR}, {_FOUND}, {_POOL}, {_VALUES}, {_RANKED}, {_RUN} select h, r, program, \"end\", n, nth from ends", typed=True)
def r07(spark, d):
    return _Parts(spark, d).ends()[2].select("h", "r", "program", "end", "n", "nth")


@query("g10_answers_from_cases", f"with {_WHOLE} select * from answer", typed=True)
def g10(spark, d):
    return _Parts(spark, d, limited=False).answers()


@query("m09_metrics_from_cases", f"with {_WHOLE}, {_JUDGED} select count(*) as n, {_MRR} from judged", typed=True)
def m09_cases(spark, d):
    p = _Parts(spark, d, limited=False)
    return rk.metrics(p.judged(p.answers()))


@query("m10_answered_metrics_by_relation", f"with {_WHOLE}, {_JUDGED} select r, count(*) as n, {_MRR} from judged where (h, r) in (select h, r from answer) group by r", typed=True)
def m10_cases(spark, d):
    p = _Parts(spark, d, limited=False)
    answers = materialize(p.answers(), "answers")
    return rk.metrics(p.judged(answers).join(answers.select("h", "r").distinct(), ["h", "r"], "left_semi"), ["r"])


@query("a26_diagnostics", f"""with {_ALL}, x as (select q.h, q.r, q.facts, coalesce(n.k, 0) as neighbours, coalesce(p.k, 0) as programs, coalesce(z.k, 0) as ran, coalesce(a.k, 0) as answers, coalesce(g.k, 0) as hits from (select h, r, count(*) as facts from test group by 1, 2) q
    left join (select h, r, count(*) as k from near group by 1, 2) n using (h, r) left join (select h, r, count(*) as k from ranked group by 1, 2) p using (h, r) left join (select h, r, count(*) as k from chosen group by 1, 2) z using (h, r) left join (select h, r, count(*) as k from answer group by 1, 2) a using (h, r)
    left join (select t.h, t.r, count(*) as k from test t join answer on answer.h = t.h and answer.r = t.r and answer.e = t.t group by 1, 2) g using (h, r))
    select count(*) as queries, cast(sum(case when programs > 0 then facts else 0 end) as bigint) as facts_with_program, round(avg(neighbours), 6) as neighbours, round(avg(programs) filter (programs > 0), 6) as programs, round(avg(programs - ran) filter (programs > 0), 6) as failed, round(avg(answers) filter (programs > 0), 6) as answers, round(sum(hits) / sum(facts), 6) as loose_accuracy from x""", typed=True)
def a26(spark, d):
    p = _Parts(spark, d)
    near, ranked, ends = p.ends()
    return cs.diagnostics(p.test, near, ranked, ends)


@query("k06_scores_of_relations", f"with {_WHOLE}, {_JUDGED}, x as (select r, count(*) as n, {_MRR} from judged where (h, r) in (select h, r from answer) group by r) select r, '{{\"hits1\":' || hits1 || ',\"hits3\":' || hits3 || ',\"hits10\":' || hits10 || ',\"mrr\":' || mrr || '}}' as json from x", typed=True)
def k06(spark, d):
    return ev.as_json(m10_cases(spark, d), "r", ["hits1", "hits3", "hits10", "mrr"])


@query("j14_prefix_programs", "select a.h, f.r, a.r || '/' || b.r as program, count(*) as n from train a join train b on b.h = a.t join train f on f.h = a.h and f.t = b.t where a.h != a.t and b.t not in (a.h, a.t) group by 1, 2, 3 union all select a.h, f.r, a.r, count(*) from train a join train f on f.h = a.h and f.t = a.t where a.h != a.t and f.r != a.r group by 1, 2, 3", typed=True)
def j14(spark, d):
    g = part(spark, d, typed=True)
    paths = pt.longest_paths(g.select(F.col("h").alias("e")).distinct(), g, 2)
    return pt.prefix_programs(paths, g)
