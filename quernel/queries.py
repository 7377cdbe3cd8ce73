"""The registered queries of the library's own operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import boolean as B
from quernel.functions import text as X
from quernel.functions.bytepairs import BytePairs
from quernel.generators import logic, machines
from quernel.operators import dedup, order, report
from quernel.operators.index import NearIndex
from quernel.operators.models import Stub, judged, scored
from quernel.plans import tasks
from quernel.sources import records, snapshots, trees
from quernel.store import new_path, saved, spread
from quernel.streaming.caps import capped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Near duplicates ------------------------------------------------------------------------------------------

_PAIRS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(dedup.coefficients(126)))


def _bands_sql(source: str, bands: int, rows: int) -> str:
    """(node, bucket) of a relation (node, text): a bucket is a band's place and all its minima."""
    return f"""
    SELECT DISTINCT node, band || ':' || string_agg(low, ',' ORDER BY i) AS bucket
    FROM (
        SELECT node, i, i // {rows} AS band, min((a * h + b) % {dedup.PRIME}) AS low
        FROM (
            SELECT DISTINCT node, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(text, p, 5), ''), lambda c: CAST(CASE WHEN c = '' THEN 0 ELSE unicode(c) END AS BIGINT))),
                lambda k, x: (k * {dedup.BASE} + x) % {dedup.PRIME}) AS h
            FROM {source}, unnest(range(1, greatest(length(text) - 4, 1) + 1)) t(p)
        ), (VALUES {_PAIRS}) m(i, a, b)
        WHERE i < {bands * rows} GROUP BY ALL
    ) GROUP BY node, band"""


def _greedy_sql(prefix: str, meets: str, x: str = "") -> str:
    """Relation ``kept`` (with ``x`` after it): nodes in order, each kept if no kept one shares a bucket with it."""
    return f"""{prefix},
    edge{x} AS (SELECT b.node AS node, list(DISTINCT a.node) AS before FROM {meets} a JOIN {meets} b ON a.bucket = b.bucket AND a.node < b.node GROUP BY b.node),
    turn{x} AS (SELECT node, row_number() OVER (ORDER BY node) AS k, coalesce(before, []) AS before FROM (SELECT DISTINCT node FROM {meets}) LEFT JOIN edge{x} USING (node)),
    walk{x} AS (
        SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept
        UNION ALL
        SELECT t.k, CASE WHEN list_has_any(w.kept, t.before) THEN w.kept ELSE list_append(w.kept, t.node) END
        FROM walk{x} w JOIN turn{x} t ON t.k = w.k + 1
    ), kept{x} AS (SELECT unnest(kept) AS node FROM (SELECT kept FROM walk{x} ORDER BY k DESC LIMIT 1))"""


_CLEAN = _greedy_sql(
    f"""WITH RECURSIVE item AS (SELECT 0 AS node, text FROM benchmark WHERE text IS NOT NULL),
    known AS (SELECT DISTINCT bucket FROM ({_bands_sql('item', 14, 9)})),
    src AS (SELECT doc_id AS node, text FROM documents WHERE text IS NOT NULL),
    met AS ({_bands_sql('src', 14, 9)}),
    free AS (SELECT * FROM met WHERE node NOT IN (SELECT node FROM met JOIN known USING (bucket)))""",
    "free",
)


@query(_CLEAN + " SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN kept ON doc_id = node GROUP BY lang")
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a corpus, by language, once near copies and what is near a benchmark are gone."""
    docs = spread(table(spark, sf_dir, "documents"))
    kept = dedup.near_dedup(docs, ["text"], "doc_id", table(spark, sf_dir, "benchmark"))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_FIRST = _greedy_sql(f"WITH RECURSIVE src AS (SELECT doc_id AS node, text FROM documents WHERE text IS NOT NULL), met AS ({_bands_sql('src', 14, 9)})", "met") + " SELECT node AS doc_id FROM kept"


@query(_FIRST)
def near_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_dedup(spread(table(spark, sf_dir, "documents")), ["text"], "doc_id").select("doc_id")


@query(_FIRST)
def near_dedup_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in five batches, by doc_id, through an index that is added to: what one run over all keeps."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    index = NearIndex(spark, new_path(spark, "near_index"), slots=16)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    kept, step = docs.select("doc_id").limit(0), ((high or 0) - (low or 0)) // 5 + 1
    for k in range(5):
        batch = docs.where((F.col("doc_id") - F.lit(low)).between(k * step, (k + 1) * step - 1))
        kept = kept.unionByName(index.add(batch, f"batch {k}", ["text"], "doc_id").select("doc_id"))
    return kept


_BY_GROUP = _greedy_sql(
    f"""WITH RECURSIVE src AS (SELECT doc_id AS node, text FROM documents WHERE text IS NOT NULL), raw AS ({_bands_sql('src', 5, 25)}),
    met AS (SELECT node, source || '|' || bucket AS bucket FROM raw JOIN documents ON node = doc_id)""",
    "met",
)


@query(_BY_GROUP + " SELECT source, count(*) AS n FROM kept JOIN documents ON node = doc_id GROUP BY source")
def near_dedup_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies within a source only, at threshold 0.9."""
    kept = dedup.near_dedup(spread(table(spark, sf_dir, "documents")), ["text"], "doc_id", threshold=0.9, group="source")
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query(_BY_GROUP + " SELECT source, count(*) AS n_before, count(kept.node) AS n_after FROM documents LEFT JOIN kept ON node = doc_id GROUP BY source")
def dedup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each source there are before and after."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    marked = dedup.near_dedup(docs, ["text"], "doc_id", threshold=0.9, group="source", mark="stays")
    return report.marked_totals(marked, ["source"], "stays")


@query(
    _greedy_sql(
        f"""WITH RECURSIVE turns AS (SELECT conv_id * 1000 + turn AS node, role, text FROM conversations),
        pair AS (SELECT a.node, a.text AS q, b.text AS r FROM turns a JOIN turns b ON b.node = a.node + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
        src AS (SELECT node, q AS text FROM pair UNION ALL SELECT node, r FROM pair), met AS ({_bands_sql('src', 14, 9)})""",
        "met",
    )
    + " SELECT node FROM kept"
)
def near_dedup_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs, neither of whose texts is near a text of an earlier pair that stays."""
    turns = table(spark, sf_dir, "conversations").withColumn("node", F.col("conv_id") * 1000 + F.col("turn"))
    asked = turns.where("role = 'user'").select("node", F.col("text").alias("q"))
    told = turns.where("role = 'assistant'").select((F.col("node") - 1).alias("node"), F.col("text").alias("r"))
    return dedup.near_dedup(asked.join(told, "node"), ["q", "r"], "node").select("node")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts, and how many there are."""
    return dedup.exact_counts(table(spark, sf_dir, "documents"), ["text"], "doc_id", "copies").select("doc_id", "copies")


@query("""SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, list_sort(string_split(text, chr(10))) AS k FROM documents)
    WHERE k NOT IN (SELECT list_sort(string_split(text, chr(10))) FROM benchmark) GROUP BY k""")
def exact_dedup_sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with equal lines in any order count as equal; those of the benchmark go."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    keyed = docs.withColumn("k", F.sha2(X.sorted_lines("text"), 256))
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return dedup.unseen(first, F.col("k"), bench, F.sha2(X.sorted_lines("text"), 256)).select("doc_id")


#: Pairs that share over 0.35 (m + n) words, as often as both have them; of these the longest common subsequence, as the
#: longest rising run among the places where words agree: a list of the least ends of runs of each length.
_ROUGE = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
    u AS MATERIALIZED (SELECT row_number() OVER () AS id, w FROM (SELECT DISTINCT w FROM d WHERE len(w) > 0)),
    b AS MATERIALIZED (SELECT row_number() OVER () AS item, w FROM (SELECT DISTINCT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) > 0),
    du AS (SELECT id, x, count(*) AS k FROM (SELECT id, unnest(w) AS x FROM u) GROUP BY ALL), bu AS (SELECT item, x, count(*) AS k FROM (SELECT item, unnest(w) AS x FROM b) GROUP BY ALL),
    p AS MATERIALIZED (SELECT id, item, u.w AS uw, b.w AS bw FROM (SELECT id, item, sum(least(du.k, bu.k)) AS k FROM du JOIN bu USING (x) GROUP BY id, item) JOIN u USING (id) JOIN b USING (item) WHERE 2 * k > 0.7 * (len(u.w) + len(b.w))),
    m AS (SELECT id, item, list([j] ORDER BY i, j DESC) AS places FROM (SELECT id, item, unnest(range(1, len(uw) + 1)) AS i, uw, bw FROM p), unnest(range(1, len(bw) + 1)) t(j) WHERE uw[i] = bw[j] GROUP BY id, item),
    l AS (SELECT id, item, len(list_reduce(list_prepend(CAST([] AS BIGINT[]), places), lambda t, x: t[1:len(list_filter(t, lambda v: v < x[1]))] || x || t[len(list_filter(t, lambda v: v < x[1])) + 2:])) AS n FROM m),
    f AS (SELECT id, max(2.0::DOUBLE * n / (len(uw) + len(bw))) AS rouge FROM l JOIN p USING (id, item) GROUP BY id)
    SELECT doc_id, CASE WHEN rouge > 0.7 THEN round(rouge, 9) END AS rouge, NOT coalesce(rouge > 0.7, false) AS stays FROM d LEFT JOIN u USING (w) LEFT JOIN f USING (id)"""


@query(_ROUGE)
def rouge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document stays, or is over 0.7 by its word-run F-measure against the benchmark, and the largest then."""
    got = dedup.rouge_over(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", F.round("rouge", 9).alias("rouge"), F.col("rouge").isNull().alias("stays"))


# Order, samples, shards -----------------------------------------------------------------------------------

@query("SELECT doc_id, row_number() OVER (ORDER BY md5('976|' || doc_id), doc_id) - 1 AS index FROM documents")
def shuffled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 976, "doc_id")


@query("""SELECT doc_id, CAST(least((i - 20) // ((n - 20) // 7), 6) AS INT) AS shard FROM (
    SELECT doc_id, row_number() OVER (ORDER BY md5('976|' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i >= 20""")
def sharded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the first 20 rows of the shuffled corpus, in 7 shards."""
    placed = order.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 976, "doc_id")
    return order.sharded(placed, 7, placed.count(), 20).select("doc_id", "shard")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn FROM documents")
def numbered_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "turn")


@query("""WITH have AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
    t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('5|' || doc_id), doc_id) - 1 AS k FROM documents)
    SELECT source, doc_id FROM t LEFT JOIN have USING (source) WHERE k < least(24 - coalesce(n, 0), 10)""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten more documents of each source, up to 24 with those that have a good label."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    have = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("n"))
    return order.quota(docs, have, "source", 24, [order.seeded_key(5, "doc_id"), F.col("doc_id")])


@query("SELECT lang, source, min_by(doc_id, {'h': md5('11|' || doc_id), 'd': doc_id}) AS doc_id FROM documents GROUP BY lang, source")
def one_of_each_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.one_each(table(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], 11, "doc_id")


@query("""WITH pool AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark)
    SELECT doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) JOIN pool ON (k + 1) % n = i""")
def cyclic_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order.numbered(table(spark, sf_dir, "documents").select("doc_id"), [], ["doc_id"], "index")
    pool = order.numbered(table(spark, sf_dir, "benchmark").select("item_id"), [], ["item_id"], "i")
    return order.cyclic(docs, pool).select("doc_id", "item_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) <= 900 AND length(source) <= 4")
def length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(order.short_enough({"text": 900, "source": 4})).select("doc_id", "n_chars")


# Rates, tiers, lookups ------------------------------------------------------------------------------------

def _results(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """Labels as test results: a source is a task, a language an experiment, good quality a pass. With ``texts`` the join
    is a shuffled one at any size: labels grow with documents."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").join(labels.hint("merge") if texts else labels, "doc_id")
    return docs.select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("exp"), F.lit("human").alias("benchmark"), (F.col("doc_id") % 3).cast("int").alias("step"),
        F.col("source").alias("task_id"), F.col("text").alias("prompt"), F.col("text").alias("completion"), (F.col("quality") == 1).alias("passed"),
    )


_RESULTS = """WITH r AS (SELECT doc_id AS row_id, lang AS exp, 'human' AS benchmark, CAST(doc_id % 3 AS INT) AS step, source AS task_id,
    text AS prompt, text AS completion, quality = 1 AS passed FROM documents JOIN labels USING (doc_id))"""


@query(_RESULTS + " SELECT task_id, step, round(avg(CAST(passed AS INT)), 9) AS pass_rate, count(*) AS n FROM r GROUP BY task_id, step")
def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pass_rate(_results(spark, sf_dir), ["task_id", "step"]).withColumn("pass_rate", F.round("pass_rate", 9))


@query(_RESULTS + """ SELECT exp, task_id, CASE WHEN avg(CAST(passed AS INT)) > 0.9 THEN 'easy' WHEN avg(CAST(passed AS INT)) < 0.2 THEN 'hard' ELSE 'soso' END AS difficulty
    FROM r GROUP BY exp, task_id""")
def difficulty_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tiers(_results(spark, sf_dir), ["exp", "task_id"]).select("exp", "task_id", "difficulty")


@query(_RESULTS + """, low AS (SELECT exp, task_id, step FROM r GROUP BY ALL HAVING avg(CAST(passed AS INT)) < 0.2)
    SELECT min_by(row_id, {'h': md5('0|' || row_id), 'd': row_id}) AS row_id, exp, task_id, step FROM r JOIN low USING (exp, task_id, step) WHERE NOT passed GROUP BY exp, task_id, step""")
def failed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failed completion of each group that passes less than a fifth of the time."""
    rows = saved(_results(spark, sf_dir, texts=True), "results")
    reference = rows.groupBy("task_id", "benchmark").agg(F.min("prompt").alias("correct"))
    return report.trajectories(rows, reference).select("row_id", "exp", "task_id", "step")


@query(_RESULTS + " SELECT exp, list(DISTINCT step ORDER BY step) AS steps FROM r GROUP BY exp")
def experiment_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that each experiment has results of."""
    return report.steps(_results(spark, sf_dir))


@query("SELECT source, sum(toxic) > 0 AS ever FROM documents JOIN labels USING (doc_id) GROUP BY source")
def ever_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return report.ever(docs, ["source"], F.col("toxic") == 1, "ever")


@query("SELECT l.doc_id, toxic, lang, source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return report.looked_up(labels, table(spark, sf_dir, "documents"), ["doc_id"], ["lang", "source"])


@query("""SELECT item_id AS id, 'benchmark' AS kind, text, NULL AS lang FROM benchmark
    UNION ALL BY NAME SELECT doc_id AS id, 'document' AS kind, text, lang FROM documents""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return order.under_one_another({"benchmark": items, "document": docs}, "kind")


@query("SELECT md5(text) AS h, count(*) AS n FROM (SELECT unnest([source, lang]) AS text FROM documents) GROUP BY text")
def stacked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = order.stacked(table(spark, sf_dir, "documents"), ["source", "lang"], "text")
    return stacked.groupBy("text").agg(F.count("*").alias("n")).select(F.md5(F.col("text").cast("binary")).alias("h"), "n")


# Text out of answers --------------------------------------------------------------------------------------

_FENCE3 = "chr(96) || chr(96) || chr(96)"
_FORMS_SQL = [
    "'so <PROBLEM> ' || text || chr(10) || ' </PROBLEM> end <PROBLEM>2</PROBLEM>'",
    "'<PROBLEM>' || text || ' </PROBL'",
    "'text </PROBLEM> then <PROBLEM> late'",
    f"'x' || {_FENCE3} || 'verilog' || chr(10) || text || chr(10) || {_FENCE3} || ' tail'",
    "'<SOLUTION>' || text || '</SOLUTION> and <REASON> for ' || source || ' </REASON></SOLUTION>'",
    "'why so <SOLUTION> one <SOLUTION> ' || text",
    "'module m(input a, ' || lang || ');' || chr(10) || text || chr(10) || 'endmodule rest endmodule more'",
    "text",
]
#: Each document in one form, and in every form.
_ANSWER = "WITH a AS (SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORMS_SQL)) + " END AS raw FROM documents)"
_WHOLE = "WITH a AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS form, CASE WHEN text IS NOT NULL THEN {x} END AS raw FROM documents" for i, x in enumerate(_FORMS_SQL)) + ")"


def _forms() -> list[Column]:
    """Answers of eight forms around a whole text."""
    t, fence, end = F.col("text"), F.lit("```"), F.lit("\n")
    return [
        F.concat(F.lit("so <PROBLEM> "), t, end, F.lit(" </PROBLEM> end <PROBLEM>2</PROBLEM>")),
        F.concat(F.lit("<PROBLEM>"), t, F.lit(" </PROBL")),
        F.lit("text </PROBLEM> then <PROBLEM> late"),
        F.concat(F.lit("x"), fence, F.lit("verilog"), end, t, end, fence, F.lit(" tail")),
        F.concat(F.lit("<SOLUTION>"), t, F.lit("</SOLUTION> and <REASON> for "), F.col("source"), F.lit(" </REASON></SOLUTION>")),
        F.concat(F.lit("why so <SOLUTION> one <SOLUTION> "), t),
        F.concat(F.lit("module m(input a, "), F.col("lang"), F.lit(");\n"), t, F.lit("\nendmodule rest endmodule more")),
        t,
    ]


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text in one of the forms: doc_id, raw."""
    raw = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, form in enumerate(_forms()):
        raw = raw.when(F.col("doc_id") % 8 == i, form)
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


def _whole_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text in every form: doc_id, form, raw."""
    forms = F.array(*[F.when(F.col("text").isNotNull(), f) for f in _forms()])
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(forms).alias("form", "raw"))


_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x{{a0}}]+', ''), '[\s\x{{a0}}]+$', '')"


def _tag_sql(tag: str, close: str | None = None) -> str:
    a, b = f"strpos(raw, '<{tag}>')", f"strpos(raw, '{close or f'</{tag}>'}')"
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN " + _STRIP.format(f"substr(raw, {a} + {len(tag) + 2}, greatest({b} - {a} - {len(tag) + 2}, 0))") + " END"


_FENCE_SQL = f"CASE WHEN regexp_matches(raw, {_FENCE3} || '.*?\\n(.*?)' || {_FENCE3}, 's') THEN regexp_extract(raw, {_FENCE3} || '.*?\\n(.*?)' || {_FENCE3}, 1, 's') ELSE raw END"


_TAGGED = f"{_tag_sql('PROBLEM')} AS tag, {_FENCE_SQL} AS code, coalesce({_tag_sql('PROBLEM', '</PROBL')}, {_FENCE_SQL}) AS problem FROM a"


@query(_ANSWER + " SELECT doc_id, " + _TAGGED)
def tagged_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", X.tagged("raw", "PROBLEM").alias("tag"), X.fenced("raw").alias("code"), X.problem("raw").alias("problem"))


_SOLVED = (
    f"""{_tag_sql('SOLUTION', '</SOLUT')} AS solution, {_tag_sql('REASON')} AS reason,
    CASE WHEN strpos(raw, '<SOLUTION>') > 0 AND strpos(raw, '</SOLUTION>') > 0 THEN """
    + _STRIP.format("substr(raw, strpos(raw, '<SOLUTION>') + 10, greatest(length(raw) - strpos(reverse(raw), reverse('</SOLUTION>')) - 9 - strpos(raw, '<SOLUTION>') - 10, 0))")
    + " WHEN strpos(raw, '<SOLUTION>') > 0 THEN "
    + _STRIP.format("string_split(raw, '<SOLUTION>')[-1]")
    + " END AS lenient FROM a"
)


@query(_ANSWER + " SELECT doc_id, " + _SOLVED)
def solutions_and_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    solution, reason = X.solution_and_reason("raw")
    lenient, _ = X.lenient_solution_and_reason("raw")
    return _answers(spark, sf_dir).select("doc_id", solution.alias("solution"), reason.alias("reason"), lenient.alias("lenient"))


_COMPLETED = (
    r""", c AS (SELECT doc_id, CASE WHEN strpos(raw, 'endmodule') > 0 THEN substr(raw, 1, length(raw) - strpos(reverse(raw), reverse('endmodule')) + 1)
    ELSE raw || chr(10) || 'endmodule' END AS cut, raw FROM a), f AS (SELECT doc_id, CASE WHEN strpos(raw, """ + _FENCE3 + r""" || 'verilog') > 0 THEN """ + _FENCE_SQL.replace("raw", "cut") + r""" ELSE cut END AS bare FROM c),
    m AS (SELECT doc_id, CASE WHEN regexp_matches(bare, '\bmodule\b.*?\bendmodule\b', 's') THEN regexp_extract(bare, '\bmodule\b.*?\bendmodule\b', 0, 's') ELSE bare END AS body FROM f)
    SELECT doc_id, CASE WHEN strpos(body, 'module ') > 0 AND strpos(body, ');') > 0 THEN substr(body, strpos(body, ');') + 2) ELSE body END AS code FROM m"""
)


@query(_ANSWER + _COMPLETED)
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("doc_id", X.completion("raw").alias("code"))


@query(_WHOLE + " SELECT doc_id, form, " + _TAGGED)
def whole_tagged_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tagged_problems over whole texts, each in every form."""
    return _whole_answers(spark, sf_dir).select("doc_id", "form", X.tagged("raw", "PROBLEM").alias("tag"), X.fenced("raw").alias("code"), X.problem("raw").alias("problem"))


@query(_WHOLE + " SELECT doc_id, form, " + _SOLVED)
def whole_solutions_and_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """solutions_and_reasons over whole texts, each in every form."""
    solution, reason = X.solution_and_reason("raw")
    lenient, _ = X.lenient_solution_and_reason("raw")
    return _whole_answers(spark, sf_dir).select("doc_id", "form", solution.alias("solution"), reason.alias("reason"), lenient.alias("lenient"))


@query(_WHOLE + _COMPLETED.replace("SELECT doc_id,", "SELECT doc_id, form,"))
def whole_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """completions over whole texts, each in every form."""
    return _whole_answers(spark, sf_dir).select("doc_id", "form", X.completion("raw").alias("code"))


@query("SELECT doc_id, 'In ' || lang || ' {' || source || '}: ' || text AS prompt FROM documents")
def whole_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of templates with whole texts."""
    prompt = X.formatted("In {lang} {{{source}}}: {text}", lang="lang", source="source", text=F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || lang || coalesce(source, 'None')), 1, 5) AS short, sha256(text) AS whole FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.fingerprint("doc_id", "lang", "source", length=5).alias("short"), X.fingerprint("text").alias("whole"))


@query(r"""SELECT conv_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))) AS BIGINT) AS tokens,
    CAST(least(1024, 3000 - sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))) - 10) AS BIGINT) AS budget,
    sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS talk FROM conversations GROUP BY conv_id""")
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations put together in order, with their tokens and what is left for an answer."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    talk = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = turns.groupBy("conv_id").agg(talk.alias("talk"), F.sum(X.token_count("text")).alias("tokens"))
    line = F.array_join(F.transform("talk", lambda t: F.concat(t.role, F.lit(": "), t.text)), "\n")
    return whole.select("conv_id", "tokens", X.token_budget("tokens", 1024, 3000).alias("budget"), F.sha2(line, 256).alias("talk"))


@query("""SELECT doc_id, 'In ' || lang || ' {' || source || '}: ' || text AS prompt,
    regexp_replace('repeat(' || n_chars || ') repeat()', 'repeat\\([0-9]*\\)', 'repeat(' || (doc_id % 7) || ')', 'g') AS bench,
    CASE WHEN doc_id % 2 = 0 THEN 'a\\_b' ELSE 'a_b' END AS raw, replace('a\\_b', '\\_', '_') AS plain FROM documents""")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prompt = X.formatted("In {lang} {{{source}}}: {text}", lang="lang", source="source", text="text")
    bench = X.repeats(F.concat(F.lit("repeat("), F.col("n_chars").cast("string"), F.lit(") repeat()")), F.col("doc_id") % 7)
    raw = F.when(F.col("doc_id") % 2 == 0, F.lit("a\\_b")).otherwise(F.lit("a_b"))
    return docs.select("doc_id", prompt.alias("prompt"), bench.alias("bench"), raw.alias("raw"), X.unescaped(F.lit("a\\_b"), "Mixtral-8x7b").alias("plain"))


@query("""WITH l AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Mismatches: 0 in ' || n_chars || ' samples' WHEN 1 THEN 'x Mismatches: ' || (doc_id % 50) || ' in 400 samples'
        WHEN 2 THEN 'Your Design Passed' ELSE 'nothing' END AS o, CASE doc_id % 6 WHEN 3 THEN 'a.v:1: syntax error' WHEN 4 THEN 'warning: Give Up' ELSE '' END AS e FROM documents),
    m AS (SELECT *, try_cast(regexp_extract(o, 'Mismatches: ([0-9]*) in ([0-9]*) samples', 1) AS INT) AS a, try_cast(regexp_extract(o, 'Mismatches: ([0-9]*) in ([0-9]*) samples', 2) AS INT) AS b FROM l)
    SELECT doc_id, CASE WHEN e LIKE '%syntax error%' THEN 'failed: syntax error.' WHEN e <> '' THEN 'failed: compile error.' WHEN o LIKE '%Passed%' THEN 'passed' WHEN a = 0 THEN 'passed'
        WHEN a IS NOT NULL THEN 'failed: ' || a || ' out of ' || b || ' samples.' ELSE 'failed: info string not matched.' END AS verdict, NOT regexp_matches(lower(e), 'error|give up') AS compiles FROM m""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    out = F.when(k == 0, F.concat(F.lit("Mismatches: 0 in "), F.col("n_chars").cast("string"), F.lit(" samples")))
    out = out.when(k == 1, F.concat(F.lit("x Mismatches: "), (F.col("doc_id") % 50).cast("string"), F.lit(" in 400 samples"))).when(k == 2, "Your Design Passed").otherwise("nothing")
    err = F.when(k == 3, "a.v:1: syntax error").when(k == 4, "warning: Give Up").otherwise("")
    return docs.select("doc_id", out.alias("o"), err.alias("e")).select("doc_id", X.verdict("o", "e", True).alias("verdict"), X.compiles("e").alias("compiles"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.element("html", "title").alias("title"), X.occurrences("html", "<p>").alias("paragraphs"))


@query("""SELECT doc_id, array_to_string(list_sort(string_split(text, chr(10))), chr(10)) AS lines,
    right(regexp_replace(text, '\\s+', '', 'g'), 1) AS last FROM documents""")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.sorted_lines("text").alias("lines"), X.last_sign("text").alias("last"))


@query("SELECT doc_id, CAST(n_chars % 5 + 0.5 AS DOUBLE) AS helpful, CAST(doc_id % 3 AS DOUBLE) AS correct FROM documents")
def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("helpful:"), (F.col("n_chars") % 5 + F.lit(0.5)).cast("string"), F.lit(",correct:"), (F.col("doc_id") % 3).cast("string"))
    got = scored(table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")), "reply")
    return got.select("doc_id", F.col("rewards")["helpful"].alias("helpful"), F.col("rewards")["correct"].alias("correct"))


@query("SELECT doc_id, n_chars % 2 = 0 AS llm_verification FROM documents")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = Stub(lambda p: f"<VALID>{int(p.rpartition(' ')[2]) % 2 == 0}</VALID><REASON>parity</REASON>")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("even? "), F.col("n_chars").cast("string")).alias("q"))
    return judged(docs, F.col("q"), judge).select("doc_id", "llm_verification")


@query(r"""SELECT doc_id, try_cast(regexp_extract('/runs/' || source || '/checkpoint-' || CASE WHEN doc_id % 3 > 0 THEN 'step=' ELSE 'last-' END || doc_id || '/all.jsonl', 'step=(\d+)', 1) AS INT) AS step
    FROM documents""")
def checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/runs/"), F.col("source"), F.lit("/checkpoint-"), F.when(F.col("doc_id") % 3 > 0, "step=").otherwise("last-"), F.col("doc_id").cast("string"), F.lit("/all.jsonl"))
    return docs.select("doc_id", records.step_of(path).alias("step"))


@query("""WITH l AS (SELECT doc_id, 'Info: ' || lang || chr(10) || 'Error (' || doc_id || '): ' || source || ' Check for and fix ' || lang || chr(10) || 'Warning' || chr(10) || 'Error (2): ' || text AS log FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_filter(string_split(log, chr(10)), lambda x: contains(x, 'Error (')), lambda x: string_split(x, 'Check for and fix')[1]), chr(10)) AS errors FROM l""")
def vendor_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat(F.lit("Info: "), "lang", F.lit("\nError ("), F.col("doc_id").cast("string"), F.lit("): "), "source", F.lit(" Check for and fix "), "lang", F.lit("\nWarning\nError (2): "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", log.alias("log")).select("doc_id", X.vendor_errors("log").alias("errors"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, array_to_string(list_transform(range(1, (len(lines) // 2) * 2 + 1), lambda i: lines[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]), chr(10)) AS swapped,
    array_to_string(list_transform(range(0, (len(lines) + 2) // 3), lambda i: array_to_string(lines[i * 3 + 1:i * 3 + 3], '|')), '#') AS chunks FROM l WHERE lines IS NOT NULL""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines swapped, and lines in chunks of three."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    chunks = F.transform(X.chunked(F.split("text", "\n", -1), 3), lambda c: F.array_join(c, "|"))
    return docs.select("doc_id", X.swapped_lines("text").alias("swapped"), F.array_join(chunks, "#").alias("chunks"))


@query(r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\s*(?:[\p{L}\p{N}]+|[^\s\p{L}\p{N}])') AS each FROM documents)
    SELECT doc_id, CAST(len(each) AS INT) AS tokens, CASE WHEN len(each) <= 50 THEN text ELSE array_to_string(each[1:50], '') END AS first FROM t""")
def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text, and the text up to its fiftieth."""
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count("text").alias("tokens"), X.token_limited("text", 50).alias("first"))


#: Rank file of a byte-level vocabulary; a parameter of what uses it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_SPACE = r"\t\n\x0B\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _bpe_sql(source: str) -> str:
    """Relation ``parts``: (id, n, hex) of each token of a relation (id, text), in order n. A mark before the last space
    of a run, where no space follows, stands for the pattern's look ahead; then, pre-token by pre-token, the pair of
    least rank is merged in each turn."""
    pattern = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^\x{{1}}{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+|\x{{1}}".replace("'", "''")
    return rf"""WITH RECURSIVE rank AS MATERIALIZED (SELECT hex(from_base64(split_part(line, ' ', 1))) AS k, CAST(split_part(line, ' ', 2) AS BIGINT) AS r
        FROM (SELECT unnest(string_split(rtrim(content, chr(10)), chr(10))) AS line FROM read_text('{RANKS}'))),
    marked AS (SELECT id, regexp_replace(text, '([{_SPACE}])([^{_SPACE}])', chr(1) || '\1\2', 'g') AS text FROM ({source})),
    piece AS MATERIALIZED (SELECT id, n, p FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS ps FROM marked), unnest(ps) WITH ORDINALITY u(p, n) WHERE p <> chr(1)),
    each AS (SELECT p, list_transform(range(1, octet_length(encode(p)) + 1), lambda i: substr(hex(encode(p)), CAST(2 * i - 1 AS BIGINT), 2)) AS own FROM (SELECT DISTINCT p FROM piece)),
    walk AS (
        SELECT p, own FROM each
        UNION ALL
        SELECT p, own[1:i - 1] || [own[i] || own[i + 1]] || own[i + 2:] FROM (
            SELECT p, own, arg_min(i, r * 100000000 + i) AS i FROM (SELECT p, own, unnest(range(1, len(own))) AS i FROM walk) JOIN rank ON k = own[i] || own[i + 1] GROUP BY p, own)
    ),
    done AS MATERIALIZED (SELECT p, arg_min(own, len(own)) AS own FROM walk GROUP BY p),
    parts AS (SELECT id, n * 100000000 + m AS n, h AS hex FROM piece JOIN done USING (p), unnest(own) WITH ORDINALITY u(h, m))"""


_CUT = "(?:[CDEF][0-9A-F]|[EF][0-9A-F][89AB][0-9A-F]|F[0-9A-F](?:[89AB][0-9A-F]){2})$"


@query(
    _bpe_sql("SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL")
    + f""", all_of AS (SELECT id, count(*) AS n, sha256(string_agg(r, ',' ORDER BY n)) AS ids, string_agg(hex, '' ORDER BY n) FILTER (WHERE turn <= 50) AS h
        FROM (SELECT id, n, hex, r, row_number() OVER (PARTITION BY id ORDER BY n) AS turn FROM parts JOIN rank ON k = hex) GROUP BY id)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(coalesce(n, 0) AS INT) END AS tokens, CASE WHEN text IS NOT NULL THEN coalesce(ids, sha256('')) END AS ids,
        CASE WHEN coalesce(n, 0) <= 50 THEN text ELSE decode(unhex(regexp_replace(h, '{_CUT}', ''))) END AS first FROM documents LEFT JOIN all_of ON doc_id = id"""
)
def token_limits_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair tokens of each text, a digest of their ids, and the text up to its fiftieth."""
    pairs = BytePairs.load(spark, RANKS)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = X.token_ids("text", pairs)
    told = docs.select("doc_id", "text", ids.alias("ids"))
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256)
    cut = F.when(F.size("ids") > 50, F.slice("ids", 1, 50))  # each text is encoded once
    first = told.select("doc_id", "text", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("tokens"), digest.alias("ids"), X.decoded(cut, pairs).alias("cut"))
    return first.select("doc_id", "tokens", "ids", F.coalesce("cut", "text").alias("first"))


@query(
    _bpe_sql("SELECT row_number() OVER () AS id, text FROM conversations WHERE text IS NOT NULL")
    + """, turn AS (SELECT conv_id, row_number() OVER () AS id FROM conversations WHERE text IS NOT NULL),
    n AS (SELECT conv_id, count(hex) AS k FROM turn LEFT JOIN parts USING (id) GROUP BY conv_id)
    SELECT conv_id, CAST(coalesce(k, 0) AS BIGINT) AS tokens, CAST(least(1024, 3000 - coalesce(k, 0) - 10) AS BIGINT) AS budget FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id)"""
)
def chats_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-pair tokens of each conversation, and what is left for an answer."""
    pairs = BytePairs.load(spark, RANKS)
    turns = table(spark, sf_dir, "conversations").select("conv_id", X.token_count(F.coalesce("text", F.lit("")), pairs).alias("n"))
    whole = turns.groupBy("conv_id").agg(F.sum("n").alias("tokens"))
    return whole.select("conv_id", "tokens", X.token_budget("tokens", 1024, 3000).alias("budget"))


# Records --------------------------------------------------------------------------------------------------

@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compressed JSON lines, and read again by the file's name."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "documents.jsonl")
    records.write_jsonl(docs, path, gzip=True)
    return records.read_table(spark, path, docs.schema)


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(ceil(count(*) OVER () / 6.0) AS BIGINT) AS size FROM documents)
    SELECT doc_id, CAST(i // size AS INT) AS shard FROM o""")
def sharded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in six runs, each in a folder of its own, as they are read again."""
    path = new_path(spark, "shards")
    records.write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, 6, ["doc_id"])
    return spark.read.schema("doc_id long, shard int").json(path).select("doc_id", "shard")


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(ceil(count(*) OVER () / 6.0) AS BIGINT) AS size FROM documents)
    SELECT doc_id, lang, 'shard-' || lpad(CAST(i // size AS VARCHAR), 5, '0') || '.jsonl' AS file FROM o""")
def named_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in six named files that appear all at once, as they are read again."""
    path = new_path(spark, "named")
    trees.write_named_shards(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, 6, ["doc_id"])
    return spark.read.schema("doc_id long, lang string").json(path).select("doc_id", "lang", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0).alias("file"))


@query(_RESULTS + " SELECT exp, step, benchmark, task_id, sha256(completion) AS completion, passed FROM r WHERE step = 1 AND exp <> 'de'")
def result_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a tree of files by experiment and checkpoint, of which a filter opens only its own."""
    path, rows = new_path(spark, "results"), _results(spark, sf_dir)
    place = F.concat(F.col("exp"), F.lit("/checkpoint-step="), F.col("step").cast("string"), F.lit("/"), F.col("benchmark"), F.lit("_0_1.jsonl_results.jsonl"))
    trees.write_named(rows.select(place.alias("file"), "task_id", "completion", "passed"), path)
    got = trees.read_results(spark, path).where("step = 1 and exp <> 'de'")
    return got.select("exp", "step", "benchmark", "task_id", F.sha2("completion", 256).alias("completion"), "passed")


@query("SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def snapshots_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's rows by way of its snapshot, which the second call finds."""
    folder = new_path(spark, "snapshots")
    stage = lambda: table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    snapshots.snapshot(stage(), folder, "sources")
    return snapshots.snapshot(stage(), folder, "sources")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn FROM documents QUALIFY turn < 10")
def capped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each source as they come in three files, by two runs of a stream."""
    path, docs = new_path(spark, "stream"), table(spark, sf_dir, "documents").select("doc_id", "source")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    for k in range(3):
        docs.where((F.col("doc_id") - F.lit(low)).between(k * step, (k + 1) * step - 1)).write.json(f"{path}/in/{k}")
        if k == 0:
            continue
        # the second run goes on from the first one's checkpoint
        arrived = spark.readStream.schema("doc_id long, source string").option("latestFirst", "false").option("maxFilesPerTrigger", 10_000).json(f"{path}/in/*")
        ended = capped(arrived, "source", "doc_id", 10).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
        ended.awaitTermination()
    return spark.read.schema("doc_id long, source string, turn long").parquet(f"{path}/out")


@query("SELECT doc_id, lang FROM documents WHERE doc_id >= 20 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty documents, from the twentieth on, that have no label yet."""
    seeds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "lang")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("index"))
    return tasks.resumed(seeds, done, 20, 50).select(F.col("index").alias("doc_id"), "lang")


@query("SELECT d.doc_id AS report_id, lang, quality = 1 AS passed, 'toxic ' || toxic AS result FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def reports_with_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), "lang")
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), (F.col("quality") == 1).alias("passed"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("result"))
    return report.by_report(reports, said)


@query(_RESULTS + """, told AS (SELECT source AS task_id, min(text) AS detail_description FROM documents GROUP BY source)
    SELECT row_id, detail_description AS problem, 'module ' || task_id || ');' || completion AS error, 'module ' || task_id || ');' || exp AS correct FROM r JOIN told USING (task_id) WHERE passed""")
def final_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passed, as records to train on: the task's description, and both codes under its header."""
    docs, rows = table(spark, sf_dir, "documents"), _results(spark, sf_dir, texts=True)
    reports = rows.select("task_id", "benchmark", "exp", "completion", F.col("exp").alias("correct"), F.lit("hard").alias("difficulty"), F.col("row_id").alias("reason"), "passed")
    told = docs.groupBy(F.col("source").alias("task_id")).agg(F.min("text").alias("detail_description")).withColumn("benchmark", F.lit("human"))
    heads = told.select("task_id", "benchmark", F.concat(F.lit("module "), "task_id", F.lit(");")).alias("header"))
    return report.final_reports(reports, told, heads, checked=True).select(F.col("reason").alias("row_id"), "problem", "error", "correct")


@query(_RESULTS + " SELECT task_id, count(*) FILTER (WHERE passed) AS k, count(*) AS n FROM r GROUP BY task_id")
def passed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.passed_of(_results(spark, sf_dir), ["task_id"])


# Generators -----------------------------------------------------------------------------------------------

def _ids(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """The ids of a table, by which functions and machines are drawn."""
    return table(spark, sf_dir, name).select(F.col(key).alias("id"))


@query("""SELECT doc_id, CAST(n_chars % 256 AS INT) AS i, CAST(xor(n_chars % 256, (n_chars % 256) >> 1) AS INT) AS gray, lpad(bin(n_chars % 256), 8, '0') AS bits,
    lpad(bin(1 << (n_chars % 8)), 8, '0') AS hot FROM documents""")
def gray_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each document's length, of eight bits."""
    i = (F.col("n_chars") % 256).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", i.alias("i"), F.get(B.gray(8), i).alias("gray"), B.bits(i, 8).alias("bits"), F.get(B.one_hot(8), i % 8).alias("hot"))


def _terms_sql(source: str, seed: str = "1234", prefix: str = "") -> str:
    """Relation ``t`` (its names after ``prefix``): the terms that each id of a relation draws."""
    p = prefix
    return f"""{p}m AS (SELECT id, 1 + CAST(('0x' || substr(md5('{seed}|' || id || '|m'), 1, 8)) AS BIGINT) % 11 AS n FROM ({source})),
    {p}v AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY md5('{seed}|' || id || '|' || i), i) AS k FROM {p}m, range(16) x(i)),
    {p}t AS (SELECT id, list(CAST(i AS INT) ORDER BY i) AS terms FROM {p}v JOIN {p}m USING (id) WHERE k <= n GROUP BY id)"""


_TERMS = "WITH " + _terms_sql("SELECT doc_id AS id FROM documents")
_LITERAL = "CASE WHEN (t >> {s}) & 1 = 1 THEN '{v}' ELSE '~{v}' END"
_PRODUCT = " || ' & ' || ".join(_LITERAL.format(s=3 - i, v=v) for i, v in enumerate("abcd"))


@query(_TERMS + f" SELECT id, terms, array_to_string(list_transform(terms, lambda t: '(' || {_PRODUCT} || ')'), ' | ') AS sop FROM t")
def sums_of_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function that each document's id draws, as a sum of products."""
    rows = logic.minterms(_ids(spark, sf_dir), variables=4, seed="1234")
    return rows.select("id", "terms", B.sum_of_products(F.col("terms"), list("abcd")).alias("sop"))


@query(_TERMS + """ SELECT id, 'a | b | c | d | f' || chr(10) || array_to_string(list_transform(range(0, 16), lambda i: ((i >> 3) & 1) || ' | ' || ((i >> 2) & 1) || ' | ' || ((i >> 1) & 1) || ' | ' || (i & 1) || ' | '
    || CASE WHEN list_contains(terms, CAST(i AS INT)) THEN 1 ELSE 0 END), chr(10)) AS truth FROM t""")
def truth_table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logic.minterms(_ids(spark, sf_dir), variables=4, seed="1234")
    return rows.select("id", B.truth_table(F.col("terms"), list("abcd"), "f").alias("truth"))


_SUM = " || ' | ' || ".join(f"CASE WHEN (t >> {3 - i}) & 1 = 0 THEN '{v}' ELSE '~{v}' END" for i, v in enumerate("abcd"))


@query(_TERMS + f""", z AS (SELECT id, terms, list_filter(range(0, 16), lambda i: NOT list_contains(terms, CAST(i AS INT))) AS zeros FROM t)
    SELECT id, array_to_string(list_transform(zeros, lambda t: '(' || {_SUM} || ')'), ' & ') AS pos,
    array_to_string(list_transform(terms, lambda t: lpad(bin(t), 4, '0') || ' => ' || {_PRODUCT}), chr(10)) AS why FROM z""")
def products_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v = logic.minterms(_ids(spark, sf_dir), variables=4, seed="1234"), list("abcd")
    return rows.select("id", B.product_of_sums(B.complement(F.col("terms"), 4), v).alias("pos"), B.explained(F.col("terms"), v).alias("why"))


@query("""SELECT doc_id AS id, list_transform(range(1, 15), lambda m: list_filter([doc_id, n_chars, length(lang), length(source)], lambda x, k: (m >> (k - 1)) & 1 = 1)) AS subsets FROM documents""")
def subset_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All choices of one to three of four numbers of each document."""
    items = F.array("doc_id", "n_chars", F.length("lang").cast("long"), F.length("source").cast("long"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), B.subsets(items, 4).alias("subsets"))


@query()
def smallest_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps with don't-cares, turned, and the smallest sum of products for each, one for each document's id."""
    return logic.karnaugh_maps(spread(_ids(spark, sf_dir)), None, "abcd", tuple("wxyz"), True, True).select("id", "input", "terms", "free", "minimal")


@query(_TERMS + ", " + _terms_sql("SELECT item_id AS id FROM benchmark", "bench", "b") + " SELECT min(id) AS id FROM t WHERE terms NOT IN (SELECT terms FROM bt) GROUP BY terms")
def distinct_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that documents' ids draw, none twice and none of those that the benchmark's draw."""
    known = logic.minterms(_ids(spark, sf_dir, "benchmark", "item_id"), variables=4, seed="bench")
    first = logic.minterms(_ids(spark, sf_dir), variables=4, seed="1234").groupBy("terms").agg(F.min("id").alias("id"))
    return dedup.unseen(first, F.col("terms"), known, F.col("terms")).select("id")


@query()
def logic_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem for each document: a table, a map, one with don't-cares or a waveform, in turn."""
    rows = spread(_ids(spark, sf_dir))
    own = [rows.where(F.pmod("id", F.lit(4)) == k) for k in range(4)]
    parts = [logic.truth_tables(own[0]), logic.karnaugh_maps(own[1]), logic.karnaugh_maps(own[2], None, "abcd", tuple("wxyz"), True), logic.waveforms(own[3])]
    out = None
    for kind, part in zip(("table", "map", "free_map", "wave"), parts, strict=True):
        part = part.select(F.lit(kind).alias("kind"), "id", "input", "output")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def machine_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine for each document, of each kind in turn, none twice and none of those that the benchmark's ids draw."""
    rows, bench = spread(_ids(spark, sf_dir)), _ids(spark, sf_dir, "benchmark", "item_id")
    out = None
    for k, kind in enumerate(machines.KINDS):
        known = machines.generated(bench, kind, seed="bench").select("key")
        part = machines.generated(rows.where(F.pmod("id", F.lit(len(machines.KINDS))) == k), kind, reference=known).select(F.lit(kind).alias("kind"), "id", "input", "output")
        out = part if out is None else out.unionByName(part)
    return out


# Tasks ----------------------------------------------------------------------------------------------------

def _echo(prompt: str) -> str:
    body = prompt.rpartition("INPUT:")[2]
    return f"<PROBLEM>{body}</PROBLEM><SOLUTION>module top_module(input a, output b);\n assign b = a; // {body}\nendmodule</SOLUTION><REASON>{len(body)}</REASON>"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select(F.col("doc_id").alias("index"), F.col("text").alias("input"), F.col("text").alias("problem"), F.col("text").alias("oss_input"), F.col("source").alias("title"), "text")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("detail_description"), F.col("text").alias("canonical_solution"))


#: What the stub says of a document's text, stripped as tags are; near copies of that, and what is near a benchmark text, go.
_ECHO = f"SELECT doc_id AS node, text AS body, CASE WHEN text IS NOT NULL THEN '<PROBLEM>' || text || '</PROBLEM><SOLUTION>module top_module(input a, output b);' || chr(10) || ' assign b = a; // ' || text || chr(10) || 'endmodule</SOLUTION><REASON>' || length(text) || '</REASON>' END AS raw FROM documents"


def _task_sql(field: str) -> str:
    return _greedy_sql(
        f"""WITH RECURSIVE item AS (SELECT 0 AS node, text FROM benchmark WHERE text IS NOT NULL), known AS (SELECT DISTINCT bucket FROM ({_bands_sql('item', 14, 9)})),
        said AS ({_ECHO}), got AS (SELECT node, body, {field} AS text, raw FROM said WHERE raw IS NOT NULL), src AS (SELECT node, text FROM got WHERE text IS NOT NULL),
        met AS ({_bands_sql('src', 14, 9)}), free AS (SELECT * FROM met WHERE node NOT IN (SELECT node FROM met JOIN known USING (bucket)))""",
        "free",
    )


@query(_task_sql(_tag_sql("PROBLEM")) + ' SELECT node AS "index", text AS problem FROM got JOIN kept USING (node)')
def problem_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tasks.Options(Stub(_echo), "Make a problem of this code.\nINPUT:{code}", context=1 << 20)
    return tasks.oss_generate_large(_seeds(spark, sf_dir), _benchmark(spark, sf_dir), o).select("index", "problem")


_ASKED = "'Is this answer right? Say True or False in VALID tags, and why in REASON tags.' || chr(10) || body || chr(10) || text"


@query(
    _task_sql(_tag_sql("SOLUTION", "</SOLUT"))
    + f""" SELECT node AS "index", text AS output, CAST(length(body) AS VARCHAR) AS reasoning, length({_ASKED}) % 2 = 0 AS llm_verification,
    CASE WHEN length({_ASKED}) % 2 = 0 THEN CAST(length(body || chr(10) || text) % 4 AS DOUBLE) END AS helpful FROM got JOIN kept USING (node)"""
)
def solution_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tasks.Options(Stub(_echo), "Solve this.\nINPUT:{problem}", context=1 << 20, judge=Stub(lambda p: f"<VALID>{len(p) % 2 == 0}</VALID><REASON>r</REASON>"), reward=Stub(lambda p: f"helpful:{len(p) % 4}"))
    return tasks.code_reason_generate(_seeds(spark, sf_dir), _benchmark(spark, sf_dir), o).select("index", "output", "reasoning", "llm_verification", F.col("rewards")["helpful"].alias("helpful"))


def _round_sql(k: int, before: str) -> str:
    """Relations of round k: what is drawn (one failed row of each low group), what of that is no near copy, and what is
    taken of each task beside what earlier rounds took."""
    low = f"""c{k} AS (SELECT exp, task_id, step, min_by(row_id, {{'h': md5('{k}|' || row_id), 'd': row_id}}) AS row_id FROM r JOIN low USING (exp, task_id, step) WHERE NOT passed GROUP BY exp, task_id, step),
    f{k} AS (SELECT row_id, task_id, exp, completion || chr(10) || chr(10) || correct AS text FROM c{k} JOIN r USING (row_id, exp, task_id, step) JOIN ref USING (task_id)),
    s{k} AS (SELECT row_id AS node, text FROM f{k} WHERE text IS NOT NULL),
    b{k} AS (SELECT node, task_id || '|' || bucket AS bucket FROM ({_bands_sql(f's{k}', 5, 25)}) JOIN f{k} ON node = row_id)"""
    taken = f"SELECT * FROM took{k - 1}" if k else "SELECT row_id, task_id, exp, text FROM f0 WHERE false"
    return _greedy_sql(before + low, f"b{k}", str(k)) + f""",
    d{k} AS (SELECT * FROM f{k} WHERE (row_id IN (SELECT node FROM kept{k}) OR text IS NULL) AND row_id NOT IN (SELECT row_id FROM ({taken}))),
    h{k} AS (SELECT task_id, count(*) AS n FROM ({taken}) GROUP BY task_id),
    took{k} AS ({taken} UNION ALL SELECT row_id, task_id, exp, text FROM (
        SELECT d{k}.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY task_id ORDER BY md5('{k}|' || row_id), row_id) - 1 AS turn FROM d{k} LEFT JOIN h{k} USING (task_id)
    ) WHERE turn < least(4 - n, 10) AND text IS NOT NULL)"""


_MINED = (
    _round_sql(
        1,
        _round_sql(
            0,
            _RESULTS.replace("WITH", "WITH RECURSIVE", 1)
            + """, low AS (SELECT exp, task_id, step FROM r GROUP BY ALL HAVING avg(CAST(passed AS INT)) < 0.2), ref AS (SELECT task_id, min(prompt) AS correct FROM r GROUP BY task_id),
    tier AS (SELECT exp, task_id, CASE WHEN avg(CAST(passed AS INT)) > 0.9 THEN 'easy' WHEN avg(CAST(passed AS INT)) < 0.2 THEN 'hard' ELSE 'soso' END AS difficulty FROM r GROUP BY exp, task_id), """,
        )
        + ", ",
    )
    + """ SELECT row_id, task_id, difficulty, CAST(length(text) + length('Say in REASON tags why the first is wrong, and give the second''s idea.') + 1 AS VARCHAR) AS reason, true AS passed
    FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY row_id) AS k FROM took1) JOIN tier USING (exp, task_id) WHERE k <= 4"""
)


@query(_MINED)
def mined_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(_results(spark, sf_dir, texts=True), "results")
    reference = rows.groupBy("task_id", "benchmark").agg(F.min("prompt").alias("correct"))
    client = Stub(lambda p: f"<REASON>{len(p)}</REASON>")
    return tasks.mine_errors(rows, reference, client, target=4, rounds=2).select("row_id", "task_id", "difficulty", "reason", "passed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

