"""Queries over what is extracted from documents: valid triples, accepted ones, concepts and their graph, document quality, question pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.formulas import half_up
from ..operators import knowledge
from ..sources import views
from .graphs import _CANON
from .triples import _VERDICTS, verdicts
from .views_sql import r6, sql

QUERIES, SQL = {}, {}


def query(name: str, statement: str | None = None):
    def add(f):
        QUERIES[name] = f
        if statement:
            SQL[name] = statement
        return f

    return add


def entity(name: Column) -> Column:
    """H-03: punctuation off both ends, white space collapsed, 2 to 120 characters, title case; else empty."""
    e = T.squeeze(F.btrim(F.btrim(name), F.lit(".,;:\"'")))
    return F.when(F.length(e).between(2, 120), F.initcap(e)).otherwise("")


def predicate(name: Column) -> Column:
    """H-04: letters, digits and underscores in upper case, at most 60; else empty."""
    token = F.upper(F.regexp_replace(F.regexp_replace(F.btrim(name), r"[^\p{L}\p{N}_\s]", ""), r"\s+", "_"))
    return F.when(F.length(token) <= 60, token).otherwise("")


def raw_triples(spark, sf_dir) -> DataFrame:
    """Relations as a model may write them: some with blank, quoted or very long names, the same name twice, or relations that are no predicate."""
    i = F.col("edge_id")
    e = views.edges(spark, sf_dir).withColumns({"s": F.concat(F.lit("concept  "), "src"), "o": F.concat(F.lit("concept "), "dst")})
    s = F.when(i % 11 == 0, "   ").when(i % 13 == 0, F.concat(F.lit(' "'), "s", F.lit('",'))).when(i % 17 == 0, F.repeat(F.lit("long "), 30)).otherwise(F.col("s"))
    o = F.when(i % 19 == 0, F.upper("s")).otherwise(F.col("o"))
    r = F.when(i % 7 == 0, "made up").when(i % 5 == 0, " is-a! ").when(i % 23 == 0, F.repeat(F.lit("x"), 61)).otherwise(F.lower(F.replace("rel", F.lit("_"), F.lit(" "))))
    return e.select("edge_id", s.alias("subject"), r.alias("relation"), o.alias("object"))


_ENTITY = "case when length({0}) between 2 and 120 then array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') else '' end"
_RAW = f"""raw as (select edge_id, case when edge_id % 11 = 0 then '   ' when edge_id % 13 = 0 then ' "concept  ' || src || '",' when edge_id % 17 = 0 then repeat('long ', 30) else 'concept  ' || src end as subject,
  case when edge_id % 7 = 0 then 'made up' when edge_id % 5 = 0 then ' is-a! ' when edge_id % 23 = 0 then repeat('x', 61) else lower(replace(rel, '_', ' ')) end as relation, case when edge_id % 19 = 0 then upper('concept  ' || src) else 'concept ' || dst end as object from edges),
spaced as (select edge_id, trim(regexp_replace(trim(trim(subject, ' '), '.,;:"'''), '\\s+', ' ', 'g'), ' ') as s, trim(regexp_replace(trim(trim(object, ' '), '.,;:"'''), '\\s+', ' ', 'g'), ' ') as o, upper(regexp_replace(regexp_replace(trim(relation, ' '), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', '_', 'g')) as r from raw),
clean as (select edge_id, {_ENTITY.format('s')} as subject, case when length(r) <= 60 then r else '' end as relation, {_ENTITY.format('o')} as object from spaced)"""


@query("triple_validity", sql("select edge_id, subject, relation, object, subject <> '' and relation <> '' and object <> '' and lower(subject) <> lower(object) and relation in (select name from predicates) as valid from clean", "edges", more=_RAW))
def triple_validity(spark, sf_dir) -> DataFrame:
    """B-11, H-03, H-04: triples with both ends, not the same, and a predicate of the ontology."""
    t = raw_triples(spark, sf_dir).select("edge_id", entity(F.col("subject")).alias("subject"), predicate(F.col("relation")).alias("relation"), entity(F.col("object")).alias("object"))
    known = F.broadcast(views.predicates(spark).select(F.col("name").alias("relation"), F.lit(True).alias("known")))  # 25 rows
    whole = (F.col("subject") != "") & (F.col("relation") != "") & (F.col("object") != "")
    valid = whole & (F.lower("subject") != F.lower("object")) & F.coalesce("known", F.lit(False))
    return t.join(known, "relation", "left").select("edge_id", "subject", "relation", "object", valid.alias("valid"))


# Chunk confidence from which triples are trusted, and under which verdicts must be surer; least confidence of verdicts a and b.
TRUSTED, DOUBTFUL = 0.70, 0.50
ORDINARY, STRICT = (0.65, 0.80), (0.88, 0.92)


def accepts(verdict: Column, confidence: Column, chunk: Column | None = None) -> Column:
    """B-15: verdicts a and b of enough confidence; with the chunk's confidence, all of good chunks and only the surest of poor ones."""
    rule = lambda least: ((verdict == "a") & (confidence >= least[0])) | ((verdict == "b") & (confidence >= least[1]))
    return rule(ORDINARY) if chunk is None else F.when(chunk >= TRUSTED, True).when(chunk < DOUBTFUL, rule(STRICT)).otherwise(rule(ORDINARY))


def _accepts_sql(verdict: str, confidence: str, least=ORDINARY) -> str:
    return f"({verdict} = 'a' and {confidence} >= {least[0]}::double or {verdict} = 'b' and {confidence} >= {least[1]}::double)"


_BAND = "case when chunk >= 0.7::double then 'trusted' when chunk < 0.5::double then 'doubtful' else 'ordinary' end"


@query("acceptance_bands", sql(f"select band, verdict, count(*)::bigint as n, sum((case band when 'trusted' then true when 'doubtful' then {_accepts_sql('verdict', 'confidence', STRICT)} else {_accepts_sql('verdict', 'confidence')} end)::int)::bigint as accepted from (select *, {_BAND} as band from (select *, ((edge_id * 29 % 101) / 100.0)::double as chunk from verdicts)) group by 1, 2", "edges", more=_VERDICTS))
def acceptance_bands(spark, sf_dir) -> DataFrame:
    """B-15: accepted triples by the confidence of their chunk and by verdict."""
    chunk = F.col("chunk")
    v = verdicts(spark, sf_dir).withColumn("chunk", ((F.col("edge_id") * 29) % 101 / 100.0).cast("double"))
    band = F.when(chunk >= TRUSTED, "trusted").when(chunk < DOUBTFUL, "doubtful").otherwise("ordinary")
    return v.groupBy(band.alias("band"), "verdict").agg(F.count("*").alias("n"), F.count_if(accepts(F.col("verdict"), F.col("confidence"), chunk)).alias("accepted"))


@query("reacceptance", sql(f"select sum(ok)::bigint as accepted, (count(*) - sum(ok))::bigint as rejected, {r6('avg(ok::double)')} as rate, avg(ok::double) >= 0.85 as passed from (select {_accepts_sql('r_verdict', 'r_confidence')}::int as ok from verdicts where src <> dst and {_accepts_sql('verdict', 'confidence')})", "edges", more=_VERDICTS))
def reacceptance(spark, sf_dir) -> DataFrame:
    """L-11: of the accepted triples, how many a second verdict accepts by the same rule; 85 % should be."""
    again = verdicts(spark, sf_dir).where((F.col("src") != F.col("dst")) & accepts(F.col("verdict"), F.col("confidence")))
    ok = accepts(F.col("r_verdict"), F.col("r_confidence")).cast("long")
    return again.agg(F.sum(ok).alias("accepted"), F.sum(1 - ok).alias("rejected"), half_up(F.avg(ok)).alias("rate"), (F.avg(ok) >= 0.85).alias("passed"))


# Properties that every concept has, and what each that some lack takes off the score.
REQUIRED, FAULT = ("id", "name", "definition", "owner", "doc"), 15


def compliance(nodes: DataFrame, properties: tuple[str, ...] = REQUIRED) -> DataFrame:
    """L-05: a row for each property: how many nodes lack it, of how many, and the score of all, 100 less FAULT for each property that any lacks."""
    missing = [F.count_if(F.coalesce(F.col(p).cast("string"), F.lit("")) == "").alias(p) for p in properties]
    one = nodes.agg(F.count("*").alias("total"), *missing)
    faults = sum((F.when(F.col(p) > 0, 1).otherwise(0) for p in properties), F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("missing")) for p in properties])).alias("r")
    share = half_up(F.coalesce(100.0 * F.col("r.missing") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)))
    return one.withColumn("score", F.greatest(F.lit(0), 100 - FAULT * faults).cast("long")).select("*", rows).select("r.property", "r.missing", "total", share.alias("percent"), (F.col("r.missing") == 0).alias("passed"), "score")


def described_nodes(spark, sf_dir) -> DataFrame:
    """Concepts with the definition that some have: a part's name."""
    p = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("definition"))
    n = views.nodes(spark, sf_dir).select(F.col("node").alias("id"), "name", "owner", views.doc_of(F.col("node")).alias("doc"))
    return n.join(p, "id", "left")


_DESCRIBED = "c as (select node as id, name, p_name as definition, owner, node // 20 as doc from nodes left join part on p_partkey = node), missing as (" + " union all ".join(f"select '{p}' as property, sum((coalesce({p}::varchar, '') = '')::int)::bigint as missing, count(*)::bigint as total from c" for p in REQUIRED) + ")"


@query("schema_compliance", sql(f"select property, missing, total, {r6('100.0::double * missing / total')} as percent, missing = 0 as passed, (100 - {FAULT} * (sum((missing > 0)::int) over ()))::bigint as score from missing", "nodes", more=_DESCRIBED))
def schema_compliance(spark, sf_dir) -> DataFrame:
    """L-05: concepts that lack an id, name, definition, owner or document."""
    return compliance(described_nodes(spark, sf_dir))


# White space as scripts other than English write it too, and the limits and weights of the five checks.
_SPACE = r"\s\x{1C}-\x{1F}\x{85}\p{Z}"
CHARS, PAGE_CHARS, DENSITY, LOST, CLEAN, WORDS, PASS = 200, 50, 100, 0.20, 0.55, 0.5, 0.70
WEIGHTS = {"extraction_yield": 0.15, "page_loss": 0.20, "text_density": 0.25, "gibberish": 0.25, "word_ratio": 0.15}


def five_checks(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """K-11: (doc_id, five scores, overall, passed, reason) of docs (doc_id, text) and pages (doc_id, text). A document of too few characters, or
    without a single word, fails whatever its score; the reason is the first check that fails, or `overall`. Documents without a page have no row."""
    strip = lambda x: F.regexp_replace(x, f"^[{_SPACE}]+|[{_SPACE}]+$", "")
    p = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.length(strip("text")) < PAGE_CHARS).alias("lost"))
    text, n = F.coalesce(F.col("text"), F.lit("")), F.col("n")
    tokens = F.regexp_extract_all(text, F.lit(f"[^{_SPACE}]+"), F.lit(0))
    runs = F.aggregate(F.filter(tokens, lambda x: F.length(x) >= 50), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    d = docs.select("doc_id", F.length(text).alias("n"), F.length(strip(text)).alias("stripped"), left(r"[\x00-\x7F]").alias("odd"), runs.alias("runs"), left(rf"[\p{{L}}\p{{N}}{_SPACE}]").alias("marks"), F.size(tokens).alias("tokens"), F.size(F.filter(tokens, lambda x: x.rlike(r"\A[A-Za-z]{2,25}\z"))).alias("words")).join(p, "doc_id")
    share = lambda c: F.col(c) / F.nullif(n, F.lit(0))
    tier = lambda x, high, most, low, some: F.when(x > high, most).when(x > low, some).otherwise(0.0)
    three = lambda x: half_up(x, 3)
    loss, ratio, density = F.col("lost") / F.col("pages"), F.coalesce(F.col("words") / F.nullif(F.col("tokens"), F.lit(0)), F.lit(0.0)), n / F.col("pages")
    penalty = tier(share("odd"), 0.15, 0.45, 0.05, 0.15) + tier(share("runs"), 0.10, 0.35, 0.03, 0.12) + tier(share("marks"), 0.30, 0.30, 0.15, 0.10)
    d = d.withColumns({
        "extraction_yield": three(F.least(F.col("stripped") / (2.0 * CHARS), F.lit(1.0))), "page_loss": three(1.0 - loss), "text_density": three(F.least(density / (2.0 * DENSITY), F.lit(1.0))),
        "gibberish": F.when(n == 0, 0.0).otherwise(three(F.greatest(1.0 - penalty, F.lit(0.0)))), "word_ratio": three(F.least(ratio / WORDS, F.lit(1.0))),
    })
    overall = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    fails = {"extraction_yield": F.col("stripped") < CHARS, "page_loss": loss > LOST, "text_density": density < DENSITY, "gibberish": F.col("gibberish") < CLEAN, "word_ratio": ratio < WORDS}
    passed = (overall >= PASS) & ~fails["extraction_yield"] & (F.col("word_ratio") > 0)
    first = F.coalesce(*[F.when(x, c) for c, x in fails.items()], F.lit("overall"))
    return d.select("doc_id", *WEIGHTS, three(overall).alias("overall"), passed.alias("passed"), F.when(passed, "").otherwise(first).alias("reason"))


def _tier_sql(x: str, high: float, most: float, low: float, some: float) -> str:
    return f"case when {x} > {high} then {most}::double when {x} > {low} then {some}::double else 0.0::double end"


_STRIP = f"regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_PENALTY = _tier_sql("odd::double / n", 0.15, 0.45, 0.05, 0.15) + " + " + _tier_sql("runs::double / n", 0.10, 0.35, 0.03, 0.12) + " + " + _tier_sql("marks::double / n", 0.30, 0.30, 0.15, 0.10)
_FIVE = f"""p as (select doc_id, count(*) as pages, sum((length({_STRIP}) < {PAGE_CHARS})::int) as lost from doc_pages group by 1),
t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') as tokens from documents),
f as (select t.doc_id, pages, lost, length(text) as n, length({_STRIP}) as stripped, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as odd, coalesce(list_sum(list_transform(list_filter(tokens, lambda x: length(x) >= 50), lambda x: length(x))), 0) as runs,
  length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{_SPACE}]', '', 'g')) as marks, len(tokens) as tokens, len(list_filter(tokens, lambda x: regexp_full_match(x, '[A-Za-z]{{2,25}}'))) as words from t join p using (doc_id)),
s as (select *, {r6(f'least(stripped / {2.0 * CHARS}::double, 1.0::double)', 3)} as extraction_yield, {r6('1.0::double - lost::double / pages', 3)} as page_loss, {r6(f'least((n::double / pages) / {2.0 * DENSITY}::double, 1.0::double)', 3)} as text_density, case when n = 0 then 0.0::double else {r6(f'greatest(1.0::double - ({_PENALTY}), 0.0::double)', 3)} end as gibberish, case when tokens = 0 then 0.0::double else {r6(f'least((words::double / tokens) / {WORDS}::double, 1.0::double)', 3)} end as word_ratio from f),
v as (select *, 0.0::double + {' + '.join(f'{w}::double * {c}' for c, w in WEIGHTS.items())} as overall from s),
w as (select *, overall >= {PASS}::double and stripped >= {CHARS} and word_ratio > 0 as passed from v)"""


@query("five_check_quality", sql(f"select doc_id, {', '.join(WEIGHTS)}, {r6('overall', 3)} as overall, passed, case when passed then '' when stripped < {CHARS} then 'extraction_yield' when lost::double / pages > {LOST}::double then 'page_loss' when n::double / pages < {DENSITY} then 'text_density' when gibberish < {CLEAN}::double then 'gibberish' when tokens = 0 or words::double / tokens < {WORDS}::double then 'word_ratio' else 'overall' end as reason from w", "doc_pages", more=_FIVE))
def five_check_quality(spark, sf_dir) -> DataFrame:
    """K-11: five weighted checks of a document, two of which can fail it alone, and why it is rejected."""
    return five_checks(views.table(spark, sf_dir, "documents"), views.doc_pages(spark, sf_dir))


#: Parts whose mentions a task holds, at most about so many.
PARTS_A_TASK = 50_000


def concept_mentions(spark, sf_dir) -> DataFrame:
    """Names of parts as mentions of concepts, in order of part and place, with what each mention says of the concept."""
    parts = views.table(spark, sf_dir, "part")
    # parts are few bytes that make many rows, which one task would hold and sort
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // PARTS_A_TASK))
    p = parts.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("definition"), F.array("p_brand", "p_type", "p_brand").alias("examples"), F.array(F.concat(F.lit("size "), F.col("p_size") % 7), F.when(F.col("p_size") % 2 == 0, F.lit(""))).alias("formulas"))
    n = views.raw_names(spark, sf_dir).repartition(tasks, "p_partkey").withColumn("key", T.canonical(F.col("name"))).join(p, "p_partkey")
    return n.withColumn("examples", F.when(F.col("pos") == 0, F.array(F.lit("seen first"))).otherwise(F.col("examples"))).withColumn("misconceptions", F.lit(None).cast("array<string>"))


def concepts(spark, sf_dir) -> DataFrame:
    return knowledge.merged_concepts(concept_mentions(spark, sf_dir), "key", ["p_partkey", "pos"], ["definition"], list(knowledge.PARTS))


_MENTIONS = """mention as (select key, c.p_partkey, pos, name, case when p_size % 3 = 0 then p_type end as definition, case when pos = 0 then ['seen first'] else [p_brand, p_type, p_brand] end as examples, ['size ' || (p_size % 7), case when p_size % 2 = 0 then '' end] as formulas from canon c join part using (p_partkey) where key <> ''),
item as (select key, prop, item, min((p_partkey, pos, i)) as first from (select key, p_partkey, pos, 'examples' as prop, unnest(examples) as item, generate_subscripts(examples, 1) as i from mention union all select key, p_partkey, pos, 'formulas', unnest(formulas), generate_subscripts(formulas, 1) from mention) where item is not null group by 1, 2, 3),
concept as (select key, min_by(name, (p_partkey, pos)) as name, min_by(definition, (p_partkey, pos)) filter (coalesce(definition, '') <> '') as definition from mention group by 1)"""


@query("concept_merge", sql("select key, name, definition, coalesce((select string_agg(item, '; ' order by first) from item i where i.key = c.key and prop = 'examples'), '') as examples, coalesce((select string_agg(item, '; ' order by first) from item i where i.key = c.key and prop = 'formulas'), '') as formulas from concept c", "raw_names", more=_CANON + ",\n" + _MENTIONS))
def concept_merge(spark, sf_dir) -> DataFrame:
    """G-02: concepts of one canonical name: the first name, the first definition, all examples and formulas in the order they came."""
    return concepts(spark, sf_dir).select("key", "name", "definition", *[F.array_join(a, "; ").alias(a) for a in ("examples", "formulas")])


def concept_relations(spark, sf_dir) -> DataFrame:
    """Relations between parts' names, as extracted: by name, in any case, some to a name that no concept has."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    j = p.join(other, "p_partkey")
    return j.select(F.upper(F.concat(F.lit("the "), "p_name", F.lit(" system"))).alias("from"), F.when(F.col("p_size") % 2 == 0, "part of").alias("type"), F.when(F.col("p_size") % 11 == 0, "nothing").otherwise(F.concat(F.lit("The "), "next", F.lit(" system "))).alias("to"))


_ID = "sha256(key)"
_SUB = "sha256(sha256(i.key) || chr(31) || prop || chr(31) || item)"
_GRAPH = """rel as (select lower(trim('the ' || a.p_name || ' system', ' ')) as f, lower(trim(case when a.p_size % 11 = 0 then 'nothing' else 'The ' || b.p_name || ' system ' end, ' ')) as t, case when a.p_size % 2 = 0 then 'PART_OF' else 'RELATES_TO' end as type from part a join part b on b.p_partkey = a.p_partkey + 1)"""


@query("concept_graph", sql(f"""select 'node' as part, {_ID} as a, 'concept' as b, name as c from concept union all select 'node', {_SUB}, prop[:-2], prop[:-2] || ': ' || left(item, 30) || '...' from item i where item <> ''
  union all select distinct 'relation', sha256(x.key), sha256(y.key), type from rel join concept x on lower(trim(x.name, ' ')) = f join concept y on lower(trim(y.name, ' ')) = t where x.key <> y.key
  union all select 'relation', sha256(i.key), {_SUB}, upper(prop) from item i where item <> ''""", "raw_names", more=_CANON + ",\n" + _MENTIONS + ",\n" + _GRAPH))
def concept_graph(spark, sf_dir) -> DataFrame:
    """J-17: concepts, their examples and formulas as nodes, and the relations between all of them; ids follow from the contents."""
    nodes, relations = knowledge.graph_tables(concepts(spark, sf_dir), concept_relations(spark, sf_dir), "key")
    one = nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("label").alias("c"))
    return one.unionByName(relations.select(F.lit("relation").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c")))


# Candidates of a slot, hours an exposure counts, and minutes after which a question may come again.
POOL, EXPOSED_HOURS, REUSE_MINUTES = 10, 72, 30
SLOT = ["concept_id", "question_type", "difficulty"]


def newest_exposures(exposures: DataFrame, now: Column, hours: int = EXPOSED_HOURS) -> DataFrame:
    """E-12: (user_id, question_id, shown_at) of the last `hours` before now, the newest of each."""
    return exposures.where(F.col("shown_at") >= now - F.expr(f"interval {hours} hours")).groupBy("user_id", "question_id").agg(F.max("shown_at").alias("shown_at"))


def sampled_questions(requests: DataFrame, pool: DataFrame, exposures: DataFrame, now: Column, seed: int = 7, most: int = POOL) -> DataFrame:
    """F-07: for each request (user_id, slot) a question of the slot's `most` oldest: one the user has not seen lately, else one seen long enough ago,
    else any; within these a seeded draw. A slot keeps its oldest before the shuffle, and a request its best candidate as an aggregate."""
    oldest = pool.withColumn("r", F.row_number().over(Window.partitionBy(*SLOT).orderBy("created_at", "question_id"))).where(F.col("r") <= most)
    c = requests.join(oldest.select(*SLOT, "question_id"), SLOT).join(newest_exposures(exposures, now), ["user_id", "question_id"], "left")
    tier = F.when(F.col("shown_at").isNull(), 1).when(F.col("shown_at") < now - F.expr(f"interval {REUSE_MINUTES} minutes"), 2).otherwise(3)
    draw = F.md5(F.concat_ws("|", F.lit(seed), "user_id", "question_id"))
    best = c.groupBy("user_id", *SLOT).agg(F.min(F.struct(tier.alias("tier"), draw.alias("draw"), "question_id")).alias("b"))
    return best.select("user_id", *SLOT, "b.question_id", "b.tier")


_POOL = """pool as (select p_partkey as question_id, p_partkey % 5 as concept_id, ['recall', 'conceptual', 'application', 'reasoning', 'analytical'][(p_partkey // 5) % 5 + 1] as question_type, p_partkey % 3 + 1 as difficulty, p_partkey * 37 % 1009 as created_at from part),
clock as (select max(ts) as now from events), shown as (select user_id, question_id, max(ts) as shown_at from (select user_id, (event_id * 31) % (select count(*) from part) as question_id, ts from events) where ts >= (select now - interval 72 hour from clock) group by 1, 2),
oldest as (select * from (select *, row_number() over (partition by concept_id, question_type, difficulty order by created_at, question_id) as r from pool) where r <= 10),
asked as (select distinct user_id, concept_id, question_type, difficulty from attempts),
ranked as (select a.*, o.question_id, case when shown_at is null then 1 when shown_at < (select now - interval 30 minute from clock) then 2 else 3 end as tier from asked a join oldest o using (concept_id, question_type, difficulty) left join shown s on s.user_id = a.user_id and s.question_id = o.question_id)"""


@query("pool_sampling", sql("select user_id, concept_id, question_type, difficulty, question_id, tier from (select *, row_number() over (partition by user_id, concept_id, question_type, difficulty order by tier, md5('7|' || user_id || '|' || question_id)) as p from ranked) where p = 1", "attempts", more=_POOL))
def pool_sampling(spark, sf_dir) -> DataFrame:
    """F-07, E-12: the next question of every learner's slots, parts standing for the pool and events for exposures, as of the last event."""
    p = views.table(spark, sf_dir, "part")
    k, i = F.col("p_partkey"), (F.floor(F.col("p_partkey") / 5) % 5).cast("int")
    pool = p.select(k.alias("question_id"), (k % 5).alias("concept_id"), F.element_at(F.lit(["recall", "conceptual", "application", "reasoning", "analytical"]), i + 1).alias("question_type"), (k % 3 + 1).alias("difficulty"), (k * 37 % 1009).alias("created_at"))
    e = views.table(spark, sf_dir, "events")
    now, n = e.agg(F.max("ts")).first()[0], p.count()
    exposures = e.select("user_id", (F.col("event_id") * 31 % n).alias("question_id"), F.col("ts").alias("shown_at"))
    return sampled_questions(views.attempts(spark, sf_dir).select("user_id", *SLOT).distinct(), pool, exposures, F.lit(now).cast("timestamp_ntz"))


@query("option_order", sql("select p_partkey as question_id, array_to_string(o, ' | ') as options, list_position(o, p_brand)::int as answer from (select p_partkey, p_brand, [x.o for x in list_sort([{'k': md5('7|' || p_partkey || '|' || o), 'o': o} for o in list_distinct([p_brand, 'Brand#' || (p_size % 25), p_type, p_name])])] as o from part)"))
def option_order(spark, sf_dir) -> DataFrame:
    """F-08: a question's options in an order drawn from a seed, and the place of the right one."""
    p = views.table(spark, sf_dir, "part")
    options = F.array_distinct(F.array("p_brand", F.concat(F.lit("Brand#"), F.col("p_size") % 25), "p_type", "p_name"))
    drawn = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(7), "p_partkey", o)).alias("k"), o.alias("o")))), lambda x: x["o"])
    o = p.select(F.col("p_partkey").alias("question_id"), "p_brand", drawn.alias("o"))
    return o.select("question_id", F.array_join("o", " | ").alias("options"), F.array_position("o", F.col("p_brand")).cast("int").alias("answer"))
