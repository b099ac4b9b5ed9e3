"""Queries: scoring, objectives, evaluation, sequence models and phrase induction at fixed weights.

Weights are a hash of feature and label, so both engines have them and no two scores tie."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.operators import chain as C
from turnloom.operators import encode as E
from turnloom.operators import evaluate as V
from turnloom.operators import linear as L
from turnloom.operators import mdl as M
from turnloom.operators.order import with_index
from turnloom.plans.data_queries import xsql
from turnloom.plans.registry import query
from turnloom.sources.shared import written
from turnloom.sources.text_files import aligned, through_a_file
from turnloom.sources.units import key_parts, table, unit_key, units, with_units


def weight(*parts):
    return ((F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 10), 16, 10).cast("long") % 2000003) / 1e6 - 1.0).cast("double")


def weight_sql(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(cast(cast('0x' || substr(md5({text}), 1, 10) as bigint) % 2000003 as double) / 1000000.0::double - 1.0::double)"


WT = f"wt as (select f, c, {weight_sql('f', 'c')} as w from dict, range(4) t(c))"
LB = "lb as (select rid, f from l union all select rid, '**BIAS**' from x)"
SC = "sc as (select rid, c, sum(w) as score from lb join wt using (f) group by rid, c)"
PR = "pr as (select rid, c, score, exp(score - m) / sum(exp(score - m)) over (partition by rid) as p from (select *, max(score) over (partition by rid) as m from sc))"
KB = "kb as (select rid, list(c order by score desc, c) as kbest from sc group by rid)"
RA = "ra as (select x.rid, x.split, label as ref, kbest[1] as ans, kbest from x join kb using (rid))"


def msql(body: str, *more: str) -> str:
    return xsql(body, E.DICTIONARY_SQL, WT, LB, SC, *more)


def _py_weight(*p: str) -> float:
    return int(hashlib.md5(":".join(p).encode()).hexdigest()[:10], 16) % 2000003 / 1e6 - 1.0


BIAS = [_py_weight("**BIAS**", str(c)) for c in range(4)]


def parts(spark, d):
    """Rows, the weights (f, w array) of all training features, and (rid, f)."""
    x = E.instances(spark, d)
    weights = E.long_form(x.where("split = 'train'")).select("f").distinct()
    return x, weights.select("f", F.array(*[weight(F.col("f"), F.lit(str(c))) for c in range(4)]).alias("w")), E.long_form(x).select("rid", "f")


def sums(spark, d):
    x, weights, long = parts(spark, d)
    return L.totals(x, long, weights, BIAS)


def scored(spark, d):
    return L.long_scores(sums(spark, d))


def r6(c):
    return F.round(c, 6)


@query("score_linear", msql("select rid, c, round(score, 6) as score from sc"))
def score_linear(spark, d):
    return scored(spark, d).select("rid", "c", r6("score").alias("score"))


@query("softmax_probs", msql("select rid, c, round(p, 6) as p from pr", PR))
def softmax_probs(spark, d):
    return sums(spark, d).select("rid", F.posexplode(L.shares(F.col("s"))).alias("c", "p")).select("rid", F.col("c").cast("long").alias("c"), r6("p").alias("p"))


@query("maxent_predict", msql("select rid, kbest[1] as pred, round(p, 6) as p from kb join pr using (rid) where c = kbest[1]", PR, KB))
def maxent_predict(spark, d):
    p = sums(spark, d).select("rid", F.array_max("s").alias("top"), F.col("s"), L.shares(F.col("s")).alias("p"))
    at = F.array_position("s", F.col("top"))  # the first of the highest
    return p.select("rid", (at - 1).cast("long").alias("pred"), r6(F.element_at("p", at.cast("int"))).alias("p"))


@query("kbest", msql("select rid, array_to_string(kbest, ' ') as kbest from kb", KB))
def kbest(spark, d):
    return L.ranked(scored(spark, d)).select("rid", F.array_join(F.transform("kbest", lambda x: x.cast("string")), " ").alias("kbest"))


@query("argmax", msql("select rid, list_position(s, list_max(s)) - 1 as best from (select rid, list(score order by c) as s from sc group by rid)"))
def argmax(spark, d):
    s = scored(spark, d).groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "score"))), lambda x: x["score"]).alias("s"))
    return s.select("rid", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("best"))


def ref_ans(spark, d):
    x = E.instances(spark, d)
    both = x.select("rid", "split", F.col("label").cast("long").alias("ref")).join(L.ranked(scored(spark, d)), "rid", "full")
    both = both.withColumn("same", F.assert_true(F.col("split").isNotNull() & F.col("kbest").isNotNull(), "references and answers differ in length"))
    return both.where("same is null").select("rid", "split", "ref", F.get("kbest", F.lit(0)).alias("ans"), "kbest")


@query("join_ref_ans", msql("select rid, cast(ref as bigint) as ref, ans from ra", KB, RA))
def join_ref_ans(spark, d):
    return ref_ans(spark, d).select("rid", "ref", "ans")


def _accuracy_sql(k: int) -> str:
    hit = f"cast(list_contains(ra.kbest[1:{k}], ra.ref) as integer)"
    return msql(
        f"select cast(t.ref as varchar) as tag, cast(coalesce(sum({hit}), 0) as bigint) as correct, count(ra.rid) as total from tags t left join ra on t.ref = ra.ref group by t.ref "
        f"union all select 'Overall', cast(sum({hit}) as bigint), count(*) from ra",
        KB, RA, f"tags as (select unnest(kbest[1:{k}]) as ref from ra union select ref from ra)",
    )


@query("accuracy", _accuracy_sql(1))
def accuracy(spark, d):
    return V.accuracy(ref_ans(spark, d), 1)


@query("accuracy_kbest", _accuracy_sql(2))
def accuracy_kbest(spark, d):
    return V.accuracy(ref_ans(spark, d), 2)


@query("accuracy_curve", msql("select cast(k as integer) as k, cast(sum(cast(list_contains(kbest[1:k], ref) as integer)) as bigint) as correct, count(*) as total from ra, range(1, 5) t(k) group by k", KB, RA))
def accuracy_curve(spark, d):
    return V.curve(ref_ans(spark, d), 4)


@query("conf_long", msql("select ref, ans, count(*) as n from ra group by ref, ans union all select ref, null, count(*) from ra group by ref union all select null, ans, count(*) from ra group by ans", KB, "ra as (select cast(label as bigint) as ref, kbest[1] as ans from x join kb using (rid))"))
def conf_long(spark, d):
    return V.confusion(ref_ans(spark, d))


@query("conf_matrix", msql("select ref, " + ", ".join(f"nullif(count(*) filter (ans = {c}), 0) as to_{c}" for c in range(4)) + ", count(*) as total from (select cast(ref as bigint) as ref, ans from ra) group by ref", KB, RA))
def conf_matrix(spark, d):
    return V.confusion_table(ref_ans(spark, d), [0, 1, 2, 3])


_BYL = "byl as (select label, sum(x) as match, sum(m) as model, sum(r) as ref from (select cast(ref as bigint) as label, 1 as r, 0 as m, cast(ref = ans as integer) as x from ra union all select ans, 0, 1, 0 from ra) group by label)"


@query(
    "crf_eval",
    msql(
        "select label, cast(match as bigint) as match, cast(model as bigint) as model, cast(ref as bigint) as ref, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 "
        "from (select *, case when model > 0 then match / model else 0 end as p, case when ref > 0 then match / ref else 0 end as r from byl)",
        KB, RA, _BYL,
    ),
)
def crf_eval(spark, d):
    return V.by_label(ref_ans(spark, d)).select("label", "match", "model", "ref", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(
    "crf_eval_total",
    msql(
        "select round(sum(p) / 4, 6) as macro_precision, round(sum(r) / 4, 6) as macro_recall, round(sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end) / 4, 6) as macro_f1, any_value(k) as items_correct, any_value(n) as items, "
        "any_value(sk) as sequences_correct, any_value(sn) as sequences from (select case when model > 0 then match / model else 0 end as p, match / ref as r from byl where ref > 0), "
        "(select cast(sum(k) as bigint) as k, cast(sum(n) as bigint) as n, count(*) filter (n = k) as sk, count(*) as sn from (select rid // 4294967296 as seq, count(*) as n, count(*) filter (ref = ans) as k from ra group by 1))",
        KB, RA, _BYL,
    ),
)
def crf_eval_total(spark, d):
    rows = ref_ans(spark, d).withColumn("seq", key_parts(F.col("rid"))[0])
    out = V.sequence_report(rows, 4)
    return out.select(*[r6(f"macro_{c}").alias(f"macro_{c}") for c in ("precision", "recall", "f1")], "items_correct", "items", "sequences_correct", "sequences")


@query(
    "binary_prf",
    msql(
        "select round(case when nh > 0 then nc / nh else 0 end, 6) as precision, round(case when nt > 0 then nc / nt else 0 end, 6) as recall from "
        "(select cast(count(*) filter (t and h) as double) as nc, cast(count(*) filter (t) as double) as nt, cast(count(*) filter (h) as double) as nh from (select label = 1 as t, score >= 0.5 as h from x join sc using (rid) where c = 1))"
    ),
)
def binary_prf(spark, d):
    """A row counts as positive at a score of 0.5 or more, as observed."""
    x = E.instances(spark, d).join(scored(spark, d).where("c = 1"), "rid").select((F.col("label") == 1).alias("t"), (F.col("score") >= 0.5).alias("h"))
    n = x.agg(*[F.sum(F.when(c, 1.0).otherwise(0.0)).alias(a) for a, c in (("nc", F.col("t") & F.col("h")), ("nt", F.col("t")), ("nh", F.col("h")))])
    return n.select(r6(F.when(F.col("nh") > 0, F.col("nc") / F.col("nh")).otherwise(0.0)).alias("precision"), r6(F.when(F.col("nt") > 0, F.col("nc") / F.col("nt")).otherwise(0.0)).alias("recall"))


@query("weighted_error", msql("select split, round(sum(m * e) / sum(m), 6) as error from (select split, rid % 7 as m, cast(ref <> ans as integer) as e from ra) where m > 0 group by split", KB, RA))
def weighted_error(spark, d):
    r = ref_ans(spark, d).select("split", (F.col("rid") % 7).alias("m"), (F.col("ref") != F.col("ans")).cast("int").alias("e")).where("m > 0")
    return r.groupBy("split").agg(r6(F.sum(F.col("m") * F.col("e")) / F.sum("m")).alias("error"))


@query("error_by_split", msql("select split, count(*) as n, round(avg(cast(ref <> ans as integer)), 6) as error from ra group by split", KB, RA))
def error_by_split(spark, d):
    return ref_ans(spark, d).groupBy("split").agg(F.count("*").alias("n"), r6(F.avg((F.col("ref") != F.col("ans")).cast("int"))).alias("error"))


@query("mean_ll", msql("select split, round(avg(ln(p)), 6) as mean_ll from pr join x using (rid) where c = label group by split", PR))
def mean_ll(spark, d):
    x = E.instances(spark, d)
    return L.softmax(scored(spark, d)).join(x.select("rid", "split", "label"), "rid").where("c = label").groupBy("split").agg(r6(F.avg(F.log("p"))).alias("mean_ll"))


@query("grid_best", msql("select k, cast(first_best as integer) as first_best, cast(last_best as integer) as last_best from (select k, min(v) filter (a = m) as first_best, max(v) filter (a = m) as last_best from (select *, max(a) over (partition by k) as m from (select rid % 5 as k, rid % 13 as v, count(*) // 8 as a from x group by 1, 2)) group by k)"))
def grid_best(spark, d):
    """Best of a grid, ties to the first and to the last setting."""
    g = E.instances(spark, d).groupBy((F.col("rid") % 5).alias("k"), (F.col("rid") % 13).alias("v")).agg(F.floor(F.count("*") / 8).alias("a"))
    first, last = F.min_by("v", F.struct(-F.col("a"), "v")), F.max_by("v", F.struct("a", "v"))
    return g.groupBy("k").agg(first.cast("int").alias("first_best"), last.cast("int").alias("last_best"))


@query("maxent_obj", msql("select round(nll + reg, 4) as objective from (select sum(-ln(p)) as nll from pr join x using (rid) where c = label), (select 0.05 * sum(w * w) as reg from wt)", PR))
def maxent_obj(spark, d):
    x, weights, long = parts(spark, d)
    push = L.pushes(L.totals(x, long, weights, BIAS), x.select("rid", "label"))
    return L.objective(push, weights, BIAS, 0.1).select(F.round("objective", 4).alias("objective"))


@query("maxent_grad", msql("select f, c, round(sum(p - cast(c = label as integer)) + 0.1 * any_value(w), 6) as g from lb join pr using (rid) join x using (rid) join wt using (f, c) group by f, c", PR))
def maxent_grad(spark, d):
    x, weights, long = parts(spark, d)
    push = L.pushes(L.totals(x, long, weights, BIAS), x.select("rid", "label"))
    g = L.gradient(long, push, weights, BIAS, 0.1)
    return g.select("f", "c", r6("g").alias("g"))


@query("suff_stats", xsql("select f, round(sum(label / 3.0::double), 6) as s from l where split = 'train' group by f"))
def suff_stats(spark, d):
    long = E.long_form(E.instances(spark, d)).where("split = 'train'")
    return long.groupBy("f").agg(r6(F.sum(F.col("label") / 3.0)).alias("s"))


_COST = "case when rid % 5 = c then cast('infinity' as double) else cast((rid + c) % 4 as double) end"


@query(
    "multilabel_obj",
    msql(
        f"select round(sum((top - cost) * (lz - score)), 4) as objective from (select *, ln(sum(exp(score - m)) over (partition by rid)) + m as lz, max(cost) over (partition by rid) as top from (select *, max(score) over (partition by rid) as m from (select *, {_COST} as cost from sc) where cost < cast('infinity' as double)))"
    ),
)
def multilabel_obj(spark, d):
    """Cost-sensitive objective: classes weigh by what they save; forbidden classes are left out."""
    s = scored(spark, d)
    s = s.where(F.col("rid") % 5 != F.col("c")).withColumn("cost", ((F.col("rid") + F.col("c")) % 4).cast("double"))
    w = Window.partitionBy("rid")
    s = s.select("rid", "score", "cost", L.log_total(F.col("score"), ["rid"]).alias("lz"), F.max("cost").over(w).alias("top"))
    return s.agg(F.round(F.sum((F.col("top") - F.col("cost")) * (F.col("lz") - F.col("score"))), 4).alias("objective"))


_HID = f"psi as (select rid, c, h, sum({weight_sql('f', 'c', 'h')}) + any_value({weight_sql(chr(39) + 'hy' + chr(39), 'c', 'h')}) as psi from lb join (select f from dict) using (f), range(4) t(c), range(2) s(h) group by rid, c, h)"


@query("lll_predict", msql("select rid, c, round(s / sum(s) over (partition by rid), 6) as p from (select rid, c, sum(exp(psi)) as s from psi group by rid, c)", _HID))
def lll_predict(spark, d):
    """Latent log-linear probabilities: two hidden states are summed out."""
    x, weights, long = parts(spark, d)
    grid = [(str(c), str(h)) for c in range(4) for h in range(2)]
    w = weights.select("f", F.array(*[weight(F.col("f"), F.lit(c), F.lit(h)) for c, h in grid]).alias("w"))
    psi = L.totals(x, long, w, [_py_weight("**BIAS**", c, h) + _py_weight("hy", c, h) for c, h in grid])
    psi = psi.select("rid", F.posexplode("s").alias("k", "psi")).select("rid", F.floor(F.col("k") / 2).cast("long").alias("c"), (F.col("k") % 2).alias("h"), "psi")
    return L.latent(psi).select("rid", "c", r6("p").alias("p"))


def _phi_sql(p: str) -> str:
    """The quantile of ``linear.normal_quantile``, from the same coefficients."""
    y = f"(2 * ({p}) - 1)"
    z = f"sqrt(-ln((1 - abs({y})) / 2))"
    poly = lambda x, cs: "(" + " + ".join(f"{c!r}::double * pow({x}, {k})" for k, c in enumerate(cs)) + ")"
    mid = f"{y} * {poly(f'{y} * {y}', L.MID[0])} / {poly(f'{y} * {y}', L.MID[1])}"
    tail = f"sign({y}) * {poly(z, L.TAIL[0])} / {poly(z, L.TAIL[1])}"
    return f"sqrt(2.0::double) * case when abs({y}) <= 0.7 then {mid} else {tail} end"


@query(
    "bns_select",
    xsql(
        f"select f, round(bns, 5) as bns from (select f, sum(abs({_phi_sql('a')} - {_phi_sql('b')})) as bns from ab group by f) order by bns desc, f limit 50",
        "cc as (select label, count(*) as nc from x group by label)", "fc as (select f, label, count(distinct rid) as k from l group by f, label)", "nf as (select f, sum(k) as n from fc group by f)",
        "ab as (select nf.f, (coalesce(k, 0) + 0.5::double) / (nc + 1.0::double) as a, (n - coalesce(k, 0) + 0.5::double) / ((select count(*) from x) - nc + 1.0::double) as b from nf cross join cc left join fc on nf.f = fc.f and cc.label = fc.label)",
    ),
)
def bns_select(spark, d):
    x = E.instances(spark, d)
    b = L.bns(E.long_form(x).select("rid", "f"), x.select("rid", "label"))
    return b.select("f", F.col("bns").alias("raw")).orderBy(F.desc("raw"), "f").limit(50).select("f", F.round("raw", 5).alias("bns"))


@query(
    "kernel_matrix",
    "with e as (select vec_id, cast(embedding as double[]) as v from embeddings), q as (select * from e where vec_id % 100 = 0) "
    "select q.vec_id as a, e.vec_id as b, round(list_dot_product(q.v, e.v), 5) as linear, round(pow(1 + list_dot_product(q.v, e.v), 2), 4) as poly, round(exp(-0.5 * pow(list_distance(q.v, e.v), 2)), 6) as rbf from q, e",
)
def kernel_matrix(spark, d):
    """Linear, polynomial and Gaussian kernels of every vector with those whose id is a multiple of 100."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("a"), F.col("v").alias("u"))
    both = q.crossJoin(e.withColumnRenamed("vec_id", "b"))  # a stated query set against all rows
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dist = F.aggregate(F.zip_with("u", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    k = both.select("a", "b", dot.alias("dot"), dist.alias("dist"))
    return k.select("a", "b", F.round("dot", 5).alias("linear"), F.round(F.pow(1 + F.col("dot"), F.lit(2)), 4).alias("poly"), r6(F.exp(-0.5 * F.col("dist"))).alias("rbf"))


@query("vec_ops", "select vec_id, round(list_dot_product(v, v), 5) as norm2, round(list_sum(list_transform(v, lambda x: 0.5 * x)), 5) as half, round(list_sum(list_transform(v, lambda x: 5 * x - x * x)), 5) as mixed from (select vec_id, cast(embedding as double[]) as v from embeddings)")
def vec_ops(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    total = lambda f: F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + f(x)), 5)
    return e.select("vec_id", total(lambda x: x * x).alias("norm2"), total(lambda x: 0.5 * x).alias("half"), total(lambda x: 5 * x - x * x).alias("mixed"))


@query("model_prune", msql("select f, c, round(w - w0, 6) as w from (select *, first(w) over (partition by f order by c) as w0, max(w) over (partition by f) - min(w) over (partition by f) as spread from (select f, c, case when id % 3 = 0 then 0.25::double else w end as w from wt join dict using (f))) where spread > 1e-10"))
def model_prune(spark, d):
    """Weights relative to class 0; features on which all classes agree are dropped."""
    _, weights, _ = parts(spark, d)
    bias = spark.createDataFrame([("**BIAS**", BIAS)], "f string, w array<double>")
    weights = weights.unionByName(bias).select("f", F.posexplode("w").alias("c", "w")).withColumn("c", F.col("c").cast("long"))
    ids = E.dictionary(E.instances(spark, d))
    w = weights.join(ids, "f").select("f", "c", F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("w")).alias("w"))
    per = w.groupBy("f").agg(F.min_by("w", "c").alias("w0"), (F.max("w") - F.min("w")).alias("spread"))
    return w.join(per.where("spread > 1e-10"), "f").select("f", "c", r6(F.col("w") - F.col("w0")).alias("w"))


# sequence models: dyads are sequences, roles are labels, all words of a turn are attributes

LABELS = ["assistant", "system", "user"]
ITEMS = "it as (select dyad as seq, pos as t, role as label, list_distinct(toks) as attrs from u)"
ATTR = "att as (select seq, t, unnest(attrs) as f from it)"
LAB = "lab(label) as (values ('assistant'), ('system'), ('user'))"
ST = f"st as (select g.seq, g.t, g.label, coalesce(h.s, 0) as s from (select seq, t, lab.label from it, lab) g left join (select seq, t, lab.label, sum({weight_sql('f', 'lab.label')}) as s from att, lab group by seq, t, lab.label) h on g.seq = h.seq and g.t = h.t and g.label = h.label)"
TR = f"tr as (select a.label as src, b.label as dst, {weight_sql(chr(39) + 'T' + chr(39), 'a.label', 'b.label')} as w from lab a, lab b)"


def lattice() -> C.Lattice:
    moves = np.array([[_py_weight("T", a, b) for b in LABELS] for a in LABELS])
    return C.Lattice(moves, np.array([_py_weight("B", x) for x in LABELS]), np.array([_py_weight("E", x) for x in LABELS]))


def items(spark, d):
    return units(spark, d).select(F.col("dyad").alias("seq"), F.col("pos").alias("t"), F.col("role").alias("label"), F.array_distinct("toks").alias("attrs"))


def states(spark, d):
    it = items(spark, d)
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    words = it.select(F.explode("attrs").alias("f")).distinct().crossJoin(F.broadcast(labels))
    return C.state_scores(it, words.select("f", "label", weight(F.col("f"), F.col("label")).alias("w")), labels)


def csql(body: str, *more: str, recursive: bool = False) -> str:
    out = with_units(body, ITEMS, ATTR, LAB, ST, TR, *more)
    return out.replace("with ", "with recursive ", 1) if recursive else out


@query("crf_state_scores", csql("select seq, t, label, round(s, 6) as s from st"))
def crf_state_scores(spark, d):
    return states(spark, d).select("seq", "t", "label", r6("s").alias("s"))


@query(
    "crf_features",
    csql(
        "select kind, src, dst, sum(freq) as freq from (select 'state' as kind, f as src, label as dst, 1.0::double as freq from att join it using (seq, t) union all "
        "select case when prev is null then 'begin' else 'trans' end, coalesce(prev, ''), label, 1 from nb union all select 'end', label, '', 1 from nb where next is null union all "
        "select 'begin', '', label, 0 from (select distinct label from it) union all select 'end', label, '', 0 from (select distinct label from it)) group by kind, src, dst",
        "nb as (select *, lag(label) over w as prev, lead(label) over w as next from it window w as (partition by seq order by t))",
    ),
)
def crf_features(spark, d):
    return C.features(items(spark, d))


@query("crf_model_compact", csql("select row_number() over (order by f, label) - 1 as id, f, label, round(w, 6) as w from (select distinct f, label, " + weight_sql("f", "label") + " as w from att, lab) where w > 0.5"))
def crf_model_compact(spark, d):
    """Weights that matter, features numbered anew without gaps."""
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    w = items(spark, d).select(F.explode("attrs").alias("f")).distinct().crossJoin(F.broadcast(labels)).select("f", "label", weight(F.col("f"), F.col("label")).alias("w")).where("w > 0.5")
    return with_index(w, "f", "label", name="id").select("id", "f", "label", r6("w").alias("w"))


_MODEL = "cm as (select f, label, w, dense_rank() over (order by f) - 1 as attr from (select distinct f, label, " + weight_sql("f", "label") + " as w from att, lab) where w > 0.5)"


@query(
    "crf_dump",
    csql(
        "select 'FILEHEADER' as section, 'num_features' as a, '' as b, cast((select count(*) from cm) + 15 as double) as w union all select 'FILEHEADER', 'num_labels', '', 3 "
        "union all select 'FILEHEADER', 'num_attrs', '', (select count(distinct attr) from cm) union all select 'LABELS', label, '', row_number() over (order by label) - 1 from lab "
        "union all select distinct 'ATTRIBUTES', f, '', attr from cm union all select 'TRANSITIONS', src, dst, round(w, 6) from tr "
        f"union all select 'TRANSITIONS_FROM_BOS', 'BOS', label, round({weight_sql(chr(39) + 'B' + chr(39), 'label')}, 6) from lab union all select 'TRANSITIONS_TO_EOS', label, 'EOS', round({weight_sql(chr(39) + 'E' + chr(39), 'label')}, 6) from lab "
        "union all select 'STATE_FEATURES', f, label, round(w, 6) from cm",
        _MODEL,
    ),
)
def crf_dump(spark, d):
    """A compact model by section: counts, labels, attributes numbered anew, moves, begins, ends and states."""
    m = lattice()
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    state = items(spark, d).select(F.explode("attrs").alias("f")).distinct().crossJoin(F.broadcast(labels)).select("f", "label", weight(F.col("f"), F.col("label")).alias("w")).where("w > 0.5")
    state = written(state, "states")
    attrs = with_index(state.select("f").distinct(), "f", name="id").select(F.lit("ATTRIBUTES").alias("section"), F.col("f").alias("a"), F.lit("").alias("b"), F.col("id").cast("double").alias("w"))
    n = state.agg(F.count("*").alias("n"), F.countDistinct("f").alias("k")).first()
    head = [("FILEHEADER", "num_features", "", float(n.n + 15)), ("FILEHEADER", "num_labels", "", 3.0), ("FILEHEADER", "num_attrs", "", float(n.k))] + [("LABELS", x, "", float(i)) for i, x in enumerate(LABELS)]
    head += [("TRANSITIONS", a, b, round(float(m.moves[i, j]), 6)) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)]
    head += [("TRANSITIONS_FROM_BOS", "BOS", x, round(float(m.begin[i]), 6)) for i, x in enumerate(LABELS)] + [("TRANSITIONS_TO_EOS", x, "EOS", round(float(m.end[i]), 6)) for i, x in enumerate(LABELS)]
    states = state.select(F.lit("STATE_FEATURES").alias("section"), F.col("f").alias("a"), F.col("label").alias("b"), r6("w").alias("w"))
    return spark.createDataFrame(head, "section string, a string, b string, w double").unionByName(attrs).unionByName(states)


# weights of begin and end are part of the first and of the last item's scores
_NUM = (
    "n as (select seq, t, label, k, len, s + case when k = 1 then " + weight_sql("'B'", "label") + " else 0 end + case when k = len then " + weight_sql("'E'", "label") + " else 0 end as s "
    "from (select *, row_number() over (partition by seq, label order by t) as k, count(*) over (partition by seq, label) as len from st))"
)
_VIT = (
    "v as (select seq, k, len, label, s as sc, [label] as path from n where k = 1 union all select * from (select v.seq, v.k + 1, any_value(v.len), n.label, max(v.sc + tr.w) + any_value(n.s), "
    "arg_max(v.path, v.sc + tr.w) || [n.label] from v join n on n.seq = v.seq and n.k = v.k + 1 join tr on tr.src = v.label and tr.dst = n.label group by v.seq, v.k, n.label))"
)
_BEST = "best as (select seq, arg_max(path, sc) as path, max(sc) as score from v where k = len group by seq)"


@query("crf_viterbi", csql("select seq, array_to_string(path, ' ') as path, round(score, 6) as score from best", _NUM, _VIT, _BEST, recursive=True))
def crf_viterbi(spark, d):
    out = C.decode(states(spark, d), LABELS, lattice())
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "ans"))), lambda x: x["ans"]), " ")
    return out.groupBy("seq").agg(path.alias("path"), r6(F.first("score")).alias("score"))


@query("crf_tag", csql("select seq, t, label as ref, path[k] as ans from best join (select seq, t, label, row_number() over (partition by seq order by t) as k from it) using (seq)", _NUM, _VIT, _BEST, recursive=True))
def crf_tag(spark, d):
    return items(spark, d).select("seq", "t", F.col("label").alias("ref")).join(C.decode(states(spark, d), LABELS, lattice()), ["seq", "t"]).select("seq", "t", "ref", "ans")


_FWD = "fw as (select seq, k, len, label, cast(s as double) as z from n where k = 1 union all select * from (select fw.seq, fw.k + 1, any_value(fw.len), n.label, ln(sum(exp(fw.z + tr.w))) + any_value(n.s) from fw join n on n.seq = fw.seq and n.k = fw.k + 1 join tr on tr.src = fw.label and tr.dst = n.label group by fw.seq, fw.k, n.label))"
_BWD = "bw as (select seq, k, label, 0.0::double as z from n where k = len union all select * from (select bw.seq, bw.k - 1, tr.src, ln(sum(exp(bw.z + m.s + tr.w))) from bw join n m on m.seq = bw.seq and m.k = bw.k and m.label = bw.label join tr on tr.dst = bw.label where bw.k > 1 group by bw.seq, bw.k, tr.src))"
_LN = "ln_z as (select seq, ln(sum(exp(z))) as log_norm from fw where k = len group by seq)"


@query("crf_forward", csql("select seq, round(log_norm, 6) as log_norm from ln_z", _NUM, _FWD, _LN, recursive=True))
def crf_forward(spark, d):
    return C.log_norms(states(spark, d), LABELS, lattice()).select("seq", r6("log_norm").alias("log_norm"))


@query("crf_marginals", csql("select n.seq, n.t, n.label, round(exp(fw.z + bw.z - log_norm), 6) as p from n join fw on n.seq = fw.seq and n.k = fw.k and n.label = fw.label join bw on n.seq = bw.seq and n.k = bw.k and n.label = bw.label join ln_z on n.seq = ln_z.seq", _NUM, _FWD, _BWD, _LN, recursive=True))
def crf_marginals(spark, d):
    return C.posteriors(states(spark, d), LABELS, lattice()).select("seq", "t", "label", r6("p").alias("p"))


@query("crf_loglik", csql("select seq, round(g - log_norm, 6) as loglik from ln_z join gold using (seq)", _NUM, _FWD, _LN, "gold as (select seq, sum(s + coalesce(w, 0)) as g from (select i.seq, n.s, tr.w from (select *, lag(label) over (partition by seq order by t) as prev from it) i join n on n.seq = i.seq and n.t = i.t and n.label = i.label left join tr on tr.src = i.prev and tr.dst = i.label) group by seq)", recursive=True))
def crf_loglik(spark, d):
    st = states(spark, d)
    w = Window.partitionBy("seq").orderBy("t")
    m = lattice()
    tr = spark.createDataFrame([(a, b, float(m.moves[i, j])) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)], "prev string, label string, w double")
    ends = spark.createDataFrame([(x, float(m.begin[i]), float(m.end[i])) for i, x in enumerate(LABELS)], "label string, b double, e double")
    gold = items(spark, d).select("seq", "t", "label", F.lag("label").over(w).alias("prev"), F.lead("label").over(w).isNull().alias("last")).join(F.broadcast(ends), "label").join(st, ["seq", "t", "label"]).join(F.broadcast(tr), ["prev", "label"], "left")
    total = gold.groupBy("seq").agg(F.sum(F.col("s") + F.coalesce("w", F.lit(0.0)) + F.when(F.col("prev").isNull(), F.col("b")).otherwise(0.0) + F.when(F.col("last"), F.col("e")).otherwise(0.0)).alias("g"))
    return total.join(C.log_norms(st, LABELS, m), "seq").select("seq", r6(F.col("g") - F.col("log_norm")).alias("loglik"))


_EXP = (
    "mg as (select n.seq, n.t, n.k, n.label, exp(fw.z + bw.z - log_norm) as p from n join fw on n.seq = fw.seq and n.k = fw.k and n.label = fw.label join bw on n.seq = bw.seq and n.k = bw.k and n.label = bw.label join ln_z on n.seq = ln_z.seq)",
    "pm as (select tr.src, tr.dst, exp(fw.z + tr.w + m.s + bw.z - log_norm) as p from fw join n m on m.seq = fw.seq and m.k = fw.k + 1 join tr on tr.src = fw.label and tr.dst = m.label join bw on bw.seq = m.seq and bw.k = m.k and bw.label = m.label join ln_z on ln_z.seq = fw.seq)",
    "gt as (select lag(label) over (partition by seq order by t) as src, label as dst from it)",
)


@query(
    "crf_gradient",
    csql(
        "select 'state' as kind, f as src, mg.label as dst, round(sum(p - cast(it.label = mg.label as integer)), 6) as g from att join it using (seq, t) join mg using (seq, t) group by f, mg.label union all "
        "select 'trans', pm.src, pm.dst, round(sum(pm.p) - (select count(*) from gt where gt.src = pm.src and gt.dst = pm.dst), 6) from pm group by pm.src, pm.dst union all "
        "select 'begin', '', mg.label, round(sum(p - cast(it.label = mg.label as integer)), 6) from mg join it using (seq, t) where k = 1 group by mg.label union all "
        "select 'end', mg.label, '', round(sum(p - cast(it.label = mg.label as integer)), 6) from mg join it using (seq, t) where (seq, t) in (select (seq, max(t)) from it group by seq) group by mg.label",
        _NUM, _FWD, _BWD, _LN, *_EXP, recursive=True,
    ),
)
def crf_gradient(spark, d):
    """Expected less observed counts of every feature, by one pass over the sequences."""
    it, st = items(spark, d), states(spark, d)
    return C.gradient(it, st, LABELS, lattice()).select("kind", "src", "dst", r6("g").alias("g"))


@query("crf_features_min", csql("select 'state' as kind, f as src, label as dst, cast(count(*) as double) as freq from att join it using (seq, t) group by f, label having count(*) >= 3"))
def crf_features_min(spark, d):
    """State features of at least three occurrences."""
    return C.features(items(spark, d), least=3).where("kind = 'state'")


@query(
    "tag_output",
    csql("select row_number() over (order by cast(seq as bigint), t) as pos, line as value from (select seq, t, label || chr(9) || path[k] || chr(9) || 'turn ' || t as line from best join (select seq, t, label, row_number() over (partition by seq order by t) as k from it) using (seq) union all select seq, max(t) + 1, '' from it group by seq)", _NUM, _VIT, _BEST, recursive=True),
)
def tag_output(spark, d):
    """Lines of reference, answer and comment, and an empty line after each sequence, in a file."""
    found = items(spark, d).select("seq", "t", F.col("label").alias("ref")).join(C.decode(states(spark, d), LABELS, lattice()), ["seq", "t"])
    lines = found.select("seq", "t", F.concat_ws("\t", "ref", "ans", F.concat(F.lit("turn "), F.col("t").cast("string"))).alias("value"))
    ends = found.groupBy("seq").agg((F.max("t") + 1).alias("t")).withColumn("value", F.lit(""))
    return through_a_file(lines.unionByName(ends).select(unit_key(F.col("seq"), F.col("t")).alias("key"), "value"), "tags", "key")


_TOTALS = " || ',' || ".join(f"count(*) filter (ans = {c})" for c in range(4))
_CELLS = " || ',' || ".join(f"coalesce(cast(nullif(count(*) filter (ans = {c}), 0) as varchar), '')" for c in range(4))


@query(
    "conf_csv",
    msql(f"select 1 as pos, ',0,1,2,3,' as value union all select 2 + cast(ref as integer), ref || ',' || {_CELLS} || ',' || count(*) from ra group by ref union all select 6, ',' || {_TOTALS} || ',' from ra", KB, RA),
)
def conf_csv(spark, d):
    """The confusion table as a CSV file: a head, a row a reference with its total, and the answers' totals."""
    rows = ref_ans(spark, d)
    labels = list(range(4))
    counts = {c: F.count(F.when(F.col("ans") == c, 1)) for c in labels}
    cell = lambda n: F.coalesce(F.nullif(n, F.lit(0)).cast("string"), F.lit(""))
    per = rows.groupBy("ref").agg(F.concat_ws(",", F.first("ref").cast("string"), *map(cell, counts.values()), F.count("*").cast("string")).alias("value")).select((F.col("ref") + 2).alias("pos"), "value")
    total = rows.agg(F.concat(F.lit(","), F.concat_ws(",", *[n.cast("string") for n in counts.values()]), F.lit(",")).alias("value")).select(F.lit(6).cast("long").alias("pos"), "value")
    head = spark.createDataFrame([(1, "," + ",".join(map(str, labels)) + ",")], "pos bigint, value string")
    return through_a_file(head.unionByName(per).unionByName(total), "confusion", "pos")


@query("eval_files", msql("select cast(count(*) filter (ref = ans) as bigint) as correct, count(*) as total from ra", KB, RA))
def eval_files(spark, d):
    """References and answers as two files of lines, some of them empty, zipped again by place."""
    rows = ref_ans(spark, d).select("rid", F.col("ref").cast("string").alias("ref"), F.concat_ws(" ", F.transform("kbest", lambda x: x.cast("string"))).alias("ans"))
    empty = rows.where("rid % 7 = 0").select((F.col("rid") * 2 + 1).alias("key"), F.lit(" ").alias("value"))
    ref = through_a_file(rows.select((F.col("rid") * 2).alias("key"), F.col("ref").alias("value")), "ref", "key")
    ans = through_a_file(rows.select((F.col("rid") * 2).alias("key"), F.col("ans").alias("value")).unionByName(empty), "ans", "key")
    both = aligned(ref, ans)
    return both.agg(F.count(F.when(F.col("left") == F.substring_index("right", " ", 1), 1)).alias("correct"), F.count("*").alias("total"))


@query(
    "coarse_fine_predict",
    msql(
        "select rid, c, round(p * q, 6) as p from (select rid, c, sum(p) over (partition by rid, c // 2) as p, e / sum(e) over (partition by rid, c // 2) as q from (select *, exp(0.5 * score) as e from pr))",
        PR,
    ),
)
def coarse_fine_predict(spark, d):
    """Probability of a label: its group's times its own within the group (a second model's)."""
    p = L.softmax(scored(spark, d)).withColumn("g", F.floor(F.col("c") / 2)).withColumn("e", F.exp(0.5 * F.col("score")))
    coarse = p.groupBy("rid", "g").agg(F.sum("p").alias("pg"))
    fine = p.groupBy("rid", "g").agg(F.sum("e").alias("eg"))
    return p.join(coarse, ["rid", "g"]).join(fine, ["rid", "g"]).select("rid", "c", r6(F.col("pg") * F.col("e") / F.col("eg")).alias("p"))


# phrase induction: dyads are documents

WORDS = "wd as (select dyad as doc, row_number() over (partition by dyad order by pos, k) as pos, w from (select dyad, pos, unnest(toks) as w, unnest(range(len(toks))) as k from u))"


def words(spark, d):
    w = units(spark, d).select("dyad", "pos", F.posexplode("toks").alias("k", "w"))
    place = F.row_number().over(Window.partitionBy("dyad").orderBy("pos", "k"))
    return w.select(F.col("dyad").alias("doc"), place.cast("long").alias("pos"), "w")


@query("mdl_index", with_units("select w, count(*) as n, min(doc || ':' || pos) as first from wd group by w", WORDS))
def mdl_index(spark, d):
    return words(spark, d).groupBy("w").agg(F.count("*").alias("n"), F.min(F.concat_ws(":", "doc", "pos")).alias("first"))


def _nl(x: str) -> str:
    return f"(case when {x} <= 0 then 0 else {x} * log2(greatest({x}, 1)) end)"


_GAIN = (
    "wn as (select w, count(*) as n from wd group by w)",
    "pa as (select a, b, count(*) as gamma, min((doc, pos)) as first from (select doc, pos, w as a, lead(w) over (partition by doc order by pos) as b from wd) where b is not null and a <> b group by a, b)",
    "ga as (select a, b, gamma, first, x.n as alpha, y.n as beta, (select count(*) from wd) as omega, (select count(*) from wn) as l from pa join wn x on x.w = a join wn y on y.w = b)",
    f"gn as (select a, b, gamma, first, {_nl('(alpha - gamma)')} + {_nl('(beta - gamma)')} + {_nl('gamma')} - {_nl('(omega - gamma)')} + {_nl('omega')} - {_nl('alpha')} - {_nl('beta')} "
    "- log2(l + 1) * (case when alpha <> gamma and beta <> gamma then len(string_split(a, '_')) + len(string_split(b, '_')) + 1 when alpha <> gamma then len(string_split(a, '_')) when beta <> gamma then len(string_split(b, '_')) else -1 end) as bits from ga)",
)


@query("mdl_scores", with_units("select a, b, gamma, round(bits, 4) as bits from gn where gamma > 1", WORDS, *_GAIN))
def mdl_scores(spark, d):
    return M.pair_gains(words(spark, d)).where("gamma > 1").select("a", "b", "gamma", F.round("bits", 4).alias("bits"))


@query("mdl_step", with_units("select a, b, round(bits, 4) as bits from gn order by bits desc, first limit 1".replace("order by bits", "order by gn.bits"), WORDS, *_GAIN))
def mdl_step(spark, d):
    return M.pair_gains(words(spark, d)).orderBy(F.desc("bits"), "first").limit(1).select("a", "b", F.round("bits", 4).alias("bits"))


@query("mdl_induct")
def mdl_induct(spark, d):
    """All merges that save more than 5 bits."""
    return M.induce(words(spark, d))
