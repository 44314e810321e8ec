"""Queries of row rules and small aggregates over the star schema, with their SQL.

Each calls the engine's operator on columns that stand in for the archive's: a name is
a part's or customer's, a year an order's, a page a line number.  Texts that a rule
reads are made from the columns of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import keys as K
from ledgerline.functions import text as T
from ledgerline.functions.parameters import resolve, same_measurement
from ledgerline.operators import batches, decisions, evidence, ledger, narrate, places, records, repairs, sampling, scoring, search, town, vocabulary
from ledgerline.plans import tools
from ledgerline.plans.catalog import ITEM_SQL, ORACLES, QUERIES, SLOT_SQL, items, points, query, standings, t
from ledgerline.sources import writers


def pick(column, *values) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (F.col(column) % len(values)).cast("int"))


def pick_sql(column: str, *values) -> str:
    text = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"list_value({text})[CAST({column} % {len(values)} AS INTEGER) + 1]"


@query("SELECT p_partkey AS id, 'https://x.org/details/p' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '' ELSE '/page/n' || (p_size - 1) END AS url FROM part")
def page_urls(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), "p_partkey").alias("identifier"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("page"))
    return x.select("id", K.page_url("https://x.org").alias("url"))


@query("SELECT user_id, substr(sha256('salt' || user_id), 1, 12) AS tag, count(*) AS n FROM events GROUP BY user_id")
def visitor_tags(spark, sf_dir):
    x = t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", K.visitor_tag("salt", F.col("user_id").cast("string")).alias("tag"), "n")


SAFE = ("report-1", "con", "a b", "LPT1.txt", "x.y_z", "trailing.")


@query(f"SELECT {pick_sql('p_partkey', *SAFE)} AS name, {pick_sql('p_partkey', 'true', 'false', 'false', 'false', 'true', 'false')} = 'true' AS safe, count(*) AS n FROM part GROUP BY 1, 2")
def safe_identifiers(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(pick("p_partkey", *SAFE).alias("name"))
    return x.withColumn("safe", K.safe_identifier("name")).groupBy("name", "safe").agg(F.count("*").alias("n"))


@query("SELECT term, count(*) AS n FROM (SELECT regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g') AS term FROM part) GROUP BY term")
def normalised_terms(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(records.normalised(F.concat_ws(" &amp; ", "p_brand", "p_name")).alias("term"))
    return x.groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT w AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS w FROM part) WHERE length(w) > 1 GROUP BY w")
def search_tokens(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(F.explode(T.search_tokens(F.concat_ws(" ", "p_name", "p_brand"))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("n"))


TITLES = ("Elora water pollution control plant", "Drinking water surveillance: Elora", "Landfill study", "Ambient air 1970", "Minutes")


@query(f"SELECT {pick_sql('p_partkey', 'water pollution control plant', 'water supply system', 'waste site', 'air monitoring', None)} AS facility, count(*) AS n FROM part GROUP BY 1")
def facility_classes(spark, sf_dir):
    return t(spark, sf_dir, "part").select(repairs.facility_of(pick("p_partkey", *TITLES)).alias("facility")).groupBy("facility").agg(F.count("*").alias("n"))


@query("SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) || ' RIVER' WHEN 1 THEN upper(s_name) || ' CREEK' END AS river FROM supplier")
def watercourses(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    station = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" River at Elora"))).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" Creek near Paris"))).otherwise(F.col("s_name"))
    return s.select(F.col("s_name").alias("name"), T.watercourse(station).alias("river"))


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer")
def lenient_numbers(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), T.lenient_number(F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.lit(" $ "), F.format_number(F.abs("c_acctbal"), 2), F.lit(" a year"))).alias("value"))


@query("SELECT trim(regexp_replace(regexp_replace(lower(c_mktsegment), '\\b(the|of)\\b', ' ', 'g'), '\\s+', ' ', 'g')) || ' plant' AS key, count(*) AS n FROM customer GROUP BY 1")
def facility_keys(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit(" "), "c_mktsegment", F.lit("  plant"))).otherwise(F.concat(F.lit("The "), "c_mktsegment", F.lit(" plant of the City "), "n_name"))
    return c.select(places.facility_key(name, "n_name").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT lower(replace(n_name || ' ' || r_name, ' ', '-')) AS slug, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def file_slugs(spark, sf_dir):
    n = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(batches.file_slug(F.concat_ws("  ", "n_name", "r_name")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


NAMES = ("Average BOD concentration", "pupils enrolled", "timber cut", "coal (tons)", "dustfall rate")


@query(f"SELECT {pick_sql('p_partkey', 'bod', 'pupils enrolled', 'timber cut', 'coal tons', 'dustfall')} AS stem, {pick_sql('p_partkey', 'water', 'education', 'forestry', 'energy', 'air')} AS domain, count(*) AS n FROM part GROUP BY 1, 2")
def stems_and_domains(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(pick("p_partkey", *NAMES).alias("name"), pick("p_partkey", "mg/l", "", "", "", "").alias("unit"))
    return x.select(vocabulary.stem("name").alias("stem"), vocabulary.domain_hint(F.concat_ws(" ", "name", "unit")).alias("domain")).groupBy("stem", "domain").agg(F.count("*").alias("n"))


MEASURED = (("BOD removal (primary section)", "%"), ("maximum daily flow", "MGD"), ("total phosphorus", "mg/L"), ("BOD objective exceeded", "%"), ("unheard of", ""))


@query(f"SELECT {pick_sql('p_partkey', 'bod removal (primary section)', 'maximum flow rate', 'total phosphorus', 'bod exceedance frequency', None)} AS label, count(*) AS n FROM part GROUP BY 1")
def parameter_labels(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(pick("p_partkey", *(m[0] for m in MEASURED)).alias("name"), pick("p_partkey", *(m[1] for m in MEASURED)).alias("unit")).groupBy("name", "unit").agg(F.count("*").alias("n"))
    return x.select(resolve("name", "unit")["label"].alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))


@query("SELECT p_partkey % 5 = p_size % 5 AS same, count(*) AS n FROM part GROUP BY 1")
def same_measurements(spark, sf_dir):
    x = t(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("a"), (F.col("p_size") % 5).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    x = x.select(*(pick(c, *(m[i] for m in MEASURED)).alias(f"{c}{i}") for c in ("a", "b") for i in (0, 1)), "n")
    return x.select(same_measurement("a0", "a1", "b0", "b1").alias("same"), "n").groupBy("same").agg(F.sum("n").alias("n"))


@query("SELECT l_partkey % 100 AS k, round(CASE l_partkey % 3 WHEN 0 THEN l_quantity * 1000000 ELSE l_quantity END, 2) AS value, CASE l_partkey % 3 WHEN 0 THEN 'gallons/day' WHEN 1 THEN 'mg/l' ELSE 'gallons/month' END AS unit, count(*) AS n FROM lineitem GROUP BY ALL")
def canonical_quantities(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("k"), "l_quantity", pick("l_partkey", "Million  Gallons per day", "mg / L", "gallons").alias("u"), pick("l_partkey", "flow", "bod", "Monthly flow").alias("p"))
    x = x.withColumn("q", repairs.canonical_quantity("l_quantity", "u", "p"))
    return x.groupBy("k", F.round("q.value", 2).alias("value"), F.col("q.unit").alias("unit")).agg(F.count("*").alias("n"))


@query("SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity < 3 THEN 'empty parameter' END, CASE WHEN l_linenumber = 1 THEN 'no value' END, CASE WHEN l_returnflag = 'R' THEN 'no unit' END, CASE WHEN l_discount > 0.09 THEN 'confidence out of range: 1.5' END, CASE WHEN l_linestatus = 'F' THEN 'no source text -- claim is not checkable' END], lambda x: x IS NOT NULL)) AS problem FROM lineitem) GROUP BY problem")
def reading_problems(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") >= 3, "bod").alias("parameter"), F.lit("observation").alias("kind"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("value"), F.when(F.col("l_returnflag") != "R", "mg/L").alias("unit"), F.when(F.col("l_discount") > 0.09, 1.5).otherwise(0.5).alias("confidence"),
        F.struct(F.when(F.col("l_linestatus") != "F", "text").alias("source_text"), F.lit("prose").alias("path")).alias("provenance"),
    )
    return x.select(F.explode(records.problems()).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS supplier, CASE WHEN count(*) > 2000 THEN 'bundle has ' || count(*) || ' records; maximum is 2000' WHEN count(DISTINCT l_orderkey) > 25 THEN 'bundle cites more than 25 unique identifiers' END AS error FROM lineitem GROUP BY l_suppkey")
def bundle_gates(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").cast("string").alias("identifier"), F.col("l_linenumber").alias("page"))
    return records.bundle_gate(x, ["supplier"])


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_nationkey IN (3, 7) GROUP BY 1")
def same_town(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" Sewage Treatment Plant no. 2")))
    wanted = ["nation_3", "Nation_7"]
    return c.where(town.same_town(place, wanted)).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_partkey % 4 IN (0, 3) GROUP BY 1")
def contradicted_measures(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_returnflag", pick("l_partkey", "concentration", "concentration", "total", "total").alias("m"), pick("l_partkey", "pounds", "mg/L", "pounds", "gallons per day").alias("u"))
    return x.where(vocabulary.contradicted("m", "u")).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def attested_names(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("quote", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("the "), "p_name", F.lit(" was sold"))).otherwise(F.concat("p_name", F.lit("s were sold"))))
    return p.where(vocabulary.attested(records.normalised(F.col("p_name")), records.normalised(F.col("quote")))).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey % 3 = 1 AS counted, count(*) AS n FROM part GROUP BY 1")
def unit_counts(spark, sf_dir):
    return t(spark, sf_dir, "part").select(evidence.unit_holds_count(pick("p_partkey", "mg/L", "3 pumps", "m3")).alias("counted")).groupBy("counted").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS line, count(*) FILTER (WHERE l_partkey % 2 = 0) AS kept, count(*) AS n FROM lineitem GROUP BY 1")
def grounded_conditions(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_linenumber", F.concat(F.lit("at "), F.col("l_quantity").cast("int").cast("string"), F.lit(" ft head")).alias("quote"), F.col("l_quantity").cast("int").cast("string").alias("q"), "l_partkey")
    condition = F.when(F.col("l_partkey") % 2 == 0, F.concat("q", F.lit(" FT head"))).otherwise(F.concat("q", F.lit(" head")))
    return x.withColumn("c", evidence.grounded_condition(condition, "quote")).groupBy(F.col("l_linenumber").alias("line")).agg(F.count("c").alias("kept"), F.count("*").alias("n"))


@query("SELECT abs(l_quantity - p_size) <= 0.01 * greatest(abs(l_quantity), abs(p_size)) AS same, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def tolerant_equality(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(scoring.values_match("l_quantity", F.col("p_size").cast("double")).alias("same")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEM_SQL} SELECT ord, title FROM it ORDER BY CASE WHEN regexp_matches(lower(title), '\\b(annual|report|yearbook|survey)\\b') THEN 0 ELSE 1 END, lower(title), ord LIMIT 20")
def reading_plans(spark, sf_dir):
    return search.reading_plan(items(spark, sf_dir)).select("ord", "title")


@query(f"WITH {ITEM_SQL} SELECT ord FROM it WHERE contains(lower(title), 'widget') AND contains(lower(publisher), 'brand#1') AND year BETWEEN 1970 AND 1990")
def filtered_index(spark, sf_dir):
    return items(spark, sf_dir).where(search.matches("Widget", "Brand#1", (1970, 1990))).select("ord")


@query("SELECT round(avg(p_size) * 500, 4) AS pages, round(avg(p_size) * 500 * 0.531, 4) AS worth, round(avg(p_size) * 500 * 0.531 * 150 / 3600, 4) AS hours FROM part")
def reading_effort(spark, sf_dir):
    x = search.effort(t(spark, sf_dir, "part").select(F.col("p_size").alias("imagecount")), 500)
    return x.select(*(F.round(c, 4).alias(c) for c in ("pages", "worth", "hours")))


@query("SELECT lower(p_type) AS key, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def vocabulary_collisions(spark, sf_dir):
    terms = t(spark, sf_dir, "part").groupBy(F.regexp_replace("p_brand", "#", " number ").alias("canonical")).agg(F.collect_set("p_type").alias("aliases"))
    return vocabulary.collisions(terms).select("key", "n")


@query("SELECT l_suppkey AS supplier, count(*) FILTER (WHERE l_returnflag = 'A') AS verified, count(*) FILTER (WHERE l_returnflag = 'N') AS unchecked, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber > 6) AS failed, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linenumber > 6) = 0 AND count(*) FILTER (WHERE l_returnflag = 'A') > 0 AS accepted FROM lineitem GROUP BY 1")
def bundle_verdicts(spark, sf_dir):
    state = F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "unchecked").when(F.col("l_linenumber") > 6, "failed").otherwise("unsupported")
    x = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), state.alias("state"))
    return ledger.verdict_counts(x, ["supplier"]).drop("unsupported")


@query("SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'title' ELSE 'letter' END AS basis, CASE WHEN l_tax >= 0.05 THEN 'high' WHEN l_tax >= 0.03 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (WHERE l_linenumber = l_suppkey % 7) AS exact, count(*) FILTER (WHERE abs(l_linenumber - l_suppkey % 7) <= 1) AS near FROM lineitem GROUP BY 1, 2")
def year_recovery(spark, sf_dir):
    tax = F.round(F.col("l_tax") * 100)
    sure = F.when(tax >= 5, 0.9).when(tax >= 3, 0.7).otherwise(0.5)
    x = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "title").otherwise("letter").alias("basis"), sure.alias("confidence"), F.col("l_linenumber").alias("year"), (F.col("l_suppkey") % 7).alias("truth"))
    return repairs.recovery_summary(x)


@query("SELECT l_orderkey % 50 AS page, count(*) AS total, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS found FROM lineitem GROUP BY 1")
def values_in_text(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("page"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(120.5)).otherwise(F.lit(977.0)).alias("value"))
    pages = x.select("page").distinct().withColumn("text", F.lit("The yield was I2O.5 tons"))
    return repairs.values_in_text(x, pages, ["page"])


@query("SELECT l_orderkey AS o, CASE WHEN count(DISTINCT l_linestatus) OVER (PARTITION BY l_orderkey, l_returnflag) > 1 THEN l_returnflag || ' (' || l_linestatus || ')' ELSE l_returnflag END AS parameter, l_linenumber AS line FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def disambiguated_columns(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("parameter"), F.col("l_linestatus").alias("column_label"), "l_linenumber").distinct()
    return records.disambiguate_columns(x, ["l_orderkey"]).select(F.col("l_orderkey").alias("o"), "parameter", F.col("l_linenumber").alias("line"))


@query("WITH x AS (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS b FROM lineitem) SELECT count(*) AS headings FROM x WHERE b IS DISTINCT FROM l_returnflag")
def shelf_headings(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_returnflag").alias("substance"), "l_linenumber", "l_partkey", "l_extendedprice")
    return repairs.shelves(x, "substance", ["l_linenumber", "l_partkey", "l_extendedprice"]).where("heading is not null").agg(F.count("*").alias("headings"))


@query("WITH f AS (SELECT o_custkey AS term, min(year(o_orderdate)) AS round FROM orders GROUP BY 1), n AS (SELECT round, count(*) AS new_terms FROM f GROUP BY 1) SELECT CAST(round AS INTEGER) AS round, new_terms, CAST(sum(new_terms) OVER (ORDER BY round) AS BIGINT) AS total FROM n")
def discovery_curve(spark, sf_dir):
    return vocabulary.discovery(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.year("o_orderdate").alias("round")))


@query("SELECT o_custkey % 7 = 0 AS generic, CASE WHEN o_custkey % 7 = 0 THEN o_orderstatus ELSE o_orderpriority END AS stratum, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' OR o_custkey % 7 = 0 GROUP BY ALL UNION ALL SELECT false, o_orderstatus, count(*) FROM orders WHERE o_orderpriority = '5-LOW' AND o_custkey % 7 <> 0 GROUP BY 2")
def first_strata(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    generic = F.col("o_custkey") % 7 == 0
    c = F.array(F.when(generic, F.lit("5-LOW")).otherwise(F.col("o_orderpriority")), F.col("o_orderstatus"))
    x = o.select(generic.alias("generic"), sampling.first_stratum(c, ["5-LOW"]).alias("stratum"), (F.col("o_orderpriority") == "5-LOW").alias("low"))
    return x.groupBy("generic", "stratum", F.when(~F.col("generic"), F.col("low")).alias("low")).agg(F.count("*").alias("n")).drop("low")


QUESTIONS = "q AS (SELECT p_partkey AS subject, p_size AS value, list_filter(['n' || p_size % 5, 'n' || p_partkey % 7], lambda x: x <> 'n0') AS needs FROM part)"


def questions(spark, sf_dir) -> DataFrame:
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    needs = F.filter(F.array(n(F.col("p_size") % 5), n(F.col("p_partkey") % 7)), lambda x: x != "n0")
    return t(spark, sf_dir, "part").select(F.lit("q").alias("kind"), F.col("p_partkey").alias("subject"), F.col("p_size").alias("value"), needs.alias("needs"))


@query(f"WITH {QUESTIONS} SELECT subject, len(needs) AS distance, value FROM q WHERE len(needs) > 0")
def waiting_questions(spark, sf_dir):
    return sampling.waiting(questions(spark, sf_dir)).select("subject", F.col("distance").cast("long").alias("distance"), "value")


@query(f"WITH {QUESTIONS} SELECT subject, value FROM q WHERE len(needs) = 1 AND needs[1] = 'n3'")
def unlocked_questions(spark, sf_dir):
    return sampling.unlocks(questions(spark, sf_dir), " N3 ").select("subject", "value")


@query("SELECT l.l_orderkey AS identifier, l.l_linenumber AS page FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey AND o_custkey % 7 = l.l_linenumber % 7)")
def resume_set(spark, sf_dir):
    pages = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("identifier"), F.col("l_linenumber").alias("page")).distinct()
    tried = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("identifier"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"), "o_custkey").where("o_custkey % 7 = page % 7")
    return repairs.not_done(pages, tried, ["identifier", "page"])


@query("SELECT CASE WHEN l_discount >= 0.09 THEN '0.90-1.00' WHEN l_discount >= 0.08 THEN '0.80-0.89' WHEN l_discount >= 0.07 THEN '0.70-0.79' WHEN l_discount >= 0.05 THEN '0.50-0.69' ELSE '0.00-0.49' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
def confidence_bands(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(batches.confidence_band(F.round(F.col("l_discount") * 10, 2)).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT source, CAST(list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS BIGINT) AS middle FROM documents GROUP BY source")
def upper_middles(spark, sf_dir):
    return t(spark, sf_dir, "documents").groupBy("source").agg(batches.upper_middle(F.collect_list("n_chars")).alias("middle"))


@query("SELECT n_name AS place, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey > 2 GROUP BY 1 HAVING count(*) >= 2")
def unlocated_places(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("place"))
    return writers.unlocated(c, t(spark, sf_dir, "nation").where("n_regionkey <= 2").select(F.col("n_name").alias("name")))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer")
def geojson_features(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_name").alias("place"), (F.col("c_nationkey") * 1.5).alias("lat"), F.col("c_acctbal").alias("lon"), F.col("c_custkey").alias("n"))
    x = writers.geojson(c).select(F.get_json_object("value", "$.properties.n").cast("long").alias("n"))
    return x.agg(F.count("*").alias("n"), F.sum("n").alias("ids"))


VOTES = "v AS (SELECT s_suppkey AS k, 'P' || chr(CAST(65 + s_suppkey % 20 AS INTEGER)) || 'ne' AS mover, 'Q' || chr(CAST(65 + s_suppkey % 7 AS INTEGER)) || 'th' AS seconder, s_suppkey % 3 AS c FROM supplier)"


def minutes(spark, sf_dir) -> DataFrame:
    s = t(spark, sf_dir, "supplier")
    letter = lambda n: F.char(F.lit(65) + (F.col("s_suppkey") % n))
    mover, seconder = F.concat(F.lit("P"), letter(20), F.lit("ne")), F.concat(F.lit("Q"), letter(7), F.lit("th"))
    nays = F.when(F.col("s_suppkey") % 3 == 0, "NAYS: Zorn -1.").when(F.col("s_suppkey") % 3 == 1, "NAYS: -0.").otherwise("NAYS: Zorn, Yule -3.")
    text = F.concat(F.lit("Moved by Alderman "), mover, F.lit(" and seconded by Mr. "), seconder, F.lit(", that it be done. CARRIED. On the hall. YEAS: Mayor Xavier, Wills -2. "), nays)
    return decisions.motions(s.select(F.col("s_suppkey").alias("identifier"), text.alias("text")), ["identifier"])


@query(f"WITH {VOTES}, a AS (SELECT mover AS p, 'moved' AS a FROM v UNION ALL SELECT seconder, 'seconded' FROM v UNION ALL SELECT unnest(['Xavier', 'Wills']), 'yea' FROM v UNION ALL SELECT 'Zorn', 'nay' FROM v WHERE c <> 1 UNION ALL SELECT 'Yule', 'nay' FROM v WHERE c = 2) SELECT lower(p) AS person, count(*) FILTER (WHERE a = 'moved') AS moved, count(*) FILTER (WHERE a = 'seconded') AS seconded, count(*) FILTER (WHERE a = 'yea') AS yea, count(*) FILTER (WHERE a = 'nay') AS nay, count(*) AS appearances FROM a GROUP BY 1")
def people_ledger(spark, sf_dir):
    return decisions.people(minutes(spark, sf_dir), "identifier").select("person", "moved", "seconded", "yea", "nay", "appearances")


@query(f"WITH {VOTES} SELECT CAST(2 * count(*) AS BIGINT) AS motions, count(*) AS recorded_votes, count(*) FILTER (WHERE c = 2) AS rolls_that_do_not_reconcile, count(*) AS rolls_checkable, CAST(0 AS BIGINT) AS rolls_with_no_tally FROM v")
def roll_checks(spark, sf_dir):
    return decisions.roll_checks(minutes(spark, sf_dir))


@query(f"WITH {VOTES} SELECT 'zorn' AS person, count(*) FILTER (WHERE c <> 1) AS nays, CAST(0 AS BIGINT) AS yeas FROM v UNION ALL SELECT 'yule', count(*) FILTER (WHERE c = 2), 0 FROM v")
def dissenters(spark, sf_dir):
    return decisions.dissenters(decisions.people(minutes(spark, sf_dir), "identifier"))


@query(f"WITH {VOTES} SELECT k AS identifier, CASE WHEN c = 0 THEN 'Zorn' ELSE 'Zorn,Yule' END AS against FROM v WHERE c <> 1 ORDER BY k LIMIT 15")
def divided_motions(spark, sf_dir):
    return decisions.divided(minutes(spark, sf_dir), ["identifier"]).select("identifier", F.array_join("against", ",").alias("against"))


QUOTED = "l_linenumber % 4"


@query(f"SELECT CASE {QUOTED} WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'failed' ELSE 'unchecked' END AS state, CASE {QUOTED} WHEN 0 THEN '' WHEN 1 THEN 'once OCR letter-for-digit damage is undone' WHEN 3 THEN 'no value to check' ELSE 'absent' END AS why, count(*) AS n FROM lineitem GROUP BY 1, 2")
def values_in_quotes(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    text = q.cast("string")
    scanned = F.concat(F.lit("the depth was "), text, F.lit("I feet"))
    k = F.col("l_linenumber") % 4
    quote = F.when(k == 1, scanned).otherwise(F.concat(F.lit("the depth was "), text, F.lit(" feet")))
    value = F.when(k == 0, q).when(k == 1, q * 10 + 1).when(k == 2, q + 1000).cast("double")
    x = t(spark, sf_dir, "lineitem").select(value.alias("value"), quote.alias("quote")).groupBy("value", "quote").agg(F.count("*").alias("n")).withColumn("s", evidence.value_state("value", "quote"))
    return x.groupBy(F.col("s.state").alias("state"), F.when(F.col("s.why").startswith("the value"), "absent").otherwise(F.col("s.why")).alias("why")).agg(F.sum("n").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN n_name || ' Sewage Works' END AS facility, CASE WHEN c_custkey % 3 = 1 THEN 'Far Town' ELSE n_name END AS place, CASE WHEN c_custkey % 3 = 0 THEN n_name || ' Sewage Works' END AS reported_place FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scoped_records(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    named = F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit("  Sewage Works"))).when(F.col("c_custkey") % 3 == 1, F.lit("Far Town"))
    rows = c.select(F.col("c_custkey").alias("id"), named.alias("place"), F.col("n_name").alias("file_place"), F.lit(None).cast("string").alias("facility"), F.lit("1960").alias("period"))
    return places.scope_records(rows, *dimensions(spark, n)).select("id", "facility", "place", "reported_place")


def dimensions(spark, nation: DataFrame) -> tuple:
    """History and aliases of one entry, and a gazetteer of the nations and one more town."""
    history = spark.createDataFrame([(["NATION_1"], "NATION_1", "city", 1.0, 2.0, "NATION_2", "merged into NATION_2", None, 1900, 1995, None, None)], places.HISTORY)
    aliases = spark.createDataFrame([(["Second Nation"], "NATION_2", None, None, None, None, None, 0.8, None)], places.ALIASES)
    row = lambda i, name: (i.cast("string").alias("id"), name.alias("name"), F.lit("Town").alias("generic_term"), F.lit("Populated Place").alias("generic_category"), F.lit("TOWN").alias("concise_code"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit("").alias("location"), F.lit("1900-01-01").alias("decision_date"))
    towns = nation.where("n_nationkey <> 1").select(*row(F.col("n_nationkey"), F.col("n_name"))).unionByName(spark.range(1).select(*row(F.lit("x"), F.lit("Far Town"))))
    return history, aliases, towns


@query("SELECT n_name AS name, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN n_nationkey = 1 AND year(o_orderdate) <= 1995 THEN 0.99::DOUBLE WHEN n_nationkey = 1 THEN 0.9::DOUBLE ELSE 0.99::DOUBLE END AS confidence, CASE WHEN n_nationkey = 1 THEN 'NATION_2' END AS superseded_by, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def places_of_an_era(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = o.groupBy(F.col("n_name").alias("name"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return places.resolve_places(x, "name", "y", *dimensions(spark, n)).select("name", "y", "place.confidence", "place.superseded_by", "n")


@query("SELECT n_name AS place, count(DISTINCT (l_returnflag, year(l_shipdate))) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def town_rows(spark, sf_dir):
    li, o, c, n = (t(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = x.groupBy(F.col("n_name").alias("place"), F.col("l_returnflag").alias("stream"), F.year("l_shipdate").cast("string").alias("period")).agg(F.min("l_quantity").alias("value"))
    none = F.lit(None).cast("string")
    rows = x.select("place", F.lit("Works").alias("facility"), F.lit("BOD").alias("parameter"), F.lit("mg/L").alias("unit"), "value", "stream", F.lit("observation").alias("kind"), "period", F.lit(0.9).alias("confidence"), none.alias("qualifier"), none.alias("condition"), F.concat("place", F.lit("-"), "stream").alias("identifier"), F.lit(1).alias("page"), F.lit("q").alias("source_text"), F.xxhash64("place", "stream", "period").alias("ord"))
    return town.rows(rows).where("charted").groupBy(F.upper("town").alias("place")).agg(F.count("*").alias("years"))


@query("SELECT c_mktsegment AS works, c_nationkey % 4 AS value, count(*) - 1 AS restated FROM customer GROUP BY 1, 2")
def subjects(spark, sf_dir):
    none = F.lit(None).cast("string")
    c = t(spark, sf_dir, "customer").select(F.lit("Elora").alias("place"), F.col("c_mktsegment").alias("facility"), none.alias("parent_facility"), F.lit("horsepower").alias("parameter"), F.lit("hp").alias("unit"), (F.col("c_nationkey") % 4).cast("double").alias("value"), F.lit("design").alias("kind"), none.alias("period"), F.col("c_name").alias("identifier"), F.lit(1).alias("page"), F.lit("q").alias("source_text"), F.col("c_custkey").alias("ord"))
    return town.subjects(c).select("works", F.col("value").cast("int").alias("value"), F.size("restatements").cast("long").alias("restated"))


@query("SELECT CASE WHEN km IS NULL THEN 'not placed' WHEN km <= 5 THEN 'likely' WHEN km <= 20 THEN 'possible' ELSE 'weak' END AS trust, count(*) AS n FROM (SELECT CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS km FROM part) GROUP BY 1")
def plant_trust(spark, sf_dir):
    return t(spark, sf_dir, "part").select(narrate.plant_confidence(F.when(F.col("p_size") % 10 != 0, F.col("p_size"))).alias("trust")).groupBy("trust").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_linenumber = 1 THEN l_quantity || ' mg/L is ' || CASE WHEN l_quantity > 20 THEN 'above' ELSE 'within' END || ' the 20 mg/L limit that applied then.' END AS verdict, count(*) AS n FROM (SELECT l_linenumber, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem) GROUP BY 1")
def judged_numbers(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, "BOD").otherwise("oddity").alias("parameter"), F.col("l_quantity").alias("value"), F.lit("mg/L").alias("unit"), F.lit(20.0).alias("era_standard")).groupBy("parameter", "value", "unit", "era_standard").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double")
    x = narrate.explain(x.select("*", none.alias("era_low"), none.alias("era_high"), F.lit(1965).alias("era_year")))
    return x.groupBy("verdict").agg(F.sum("n").alias("n"))


@query("SELECT o_custkey AS place, 'c' || o_custkey || ': ' || count(DISTINCT year(o_orderdate)) || ' reports ' || min(year(o_orderdate)) || '-' || max(year(o_orderdate)) AS said FROM orders GROUP BY 1")
def silence_sentences(spark, sf_dir):
    from ledgerline.operators import series

    x = series.silence(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.year("o_orderdate").alias("year")), ["place"])
    return x.select("place", F.split_part(narrate.silence_sentence(F.concat(F.lit("c"), F.col("place").cast("string"))), F.lit(" ("), F.lit(1)).alias("said"))


@query("SELECT series, CASE WHEN count(*) < 6 THEN 'no trend computed: only ' || count(*) || ' readings; need 6' ELSE 'computed' END AS said FROM (SELECT DISTINCT event_type AS series, day(ts) AS d FROM events) GROUP BY 1")
def trend_sentences(spark, sf_dir):
    from ledgerline.operators import series

    said = narrate.trend_sentence()
    return series.trend(points(spark, sf_dir), ["series"]).select("series", F.when(F.col("ok"), "computed").otherwise(said).alias("said"))


@query("SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 1")
def vocabulary_matches(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    terms = p.groupBy(F.lower("p_type").alias("canonical")).agg(F.count("*").alias("readings_covered")).withColumn("aliases", F.array().cast("array<string>"))
    x = vocabulary.matched(p.select(F.concat(F.lit(" "), F.upper("p_type"), F.lit("!")).alias("parameter")), terms)
    return x.where("known").groupBy(F.upper("term").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(1)


@query("SELECT p_brand AS publisher, count(DISTINCT p_name) AS families FROM part GROUP BY 1")
def title_families(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_brand", batches.title_family(F.concat("p_name", F.lit(" 19"), F.col("p_size").cast("string"))).alias("f"))
    return p.groupBy(F.col("p_brand").alias("publisher")).agg(F.count_distinct("f").alias("families"))


@query("WITH x AS (SELECT n_name AS place, min(c_custkey) AS o, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT place, n, 'new' AS state FROM x ORDER BY n DESC, place LIMIT 5")
def batch_plan(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    selection = c.select(F.col("n_name").alias("place"), F.col("c_name").alias("identifier"), F.col("c_custkey").alias("at"))
    results = spark.createDataFrame([], "place string, valid boolean, receipt boolean, pass_seen boolean, modified int")
    return batches.plan(selection, results, 5).select("place", "n", "state")


@query("SELECT n_name AS place, count(*) AS n, sha256('[' || string_agg('\"' || c_name || '\"', ',' ORDER BY c_custkey) || ']') AS fingerprint FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def selection_fingerprints(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = batches.selection_fingerprint(c.select(F.col("n_name").alias("place"), F.col("c_name").alias("identifier"), F.col("c_custkey").alias("at")))
    return x.select("place", F.col("n").cast("long").alias("n"), "fingerprint")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'change' WHEN o_orderkey % 3 = 1 THEN 'agree' ELSE 'abstain' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def corrected_years(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    other = (F.year("o_orderdate") - 10).cast("string")
    quote = F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("the flow in "), y, F.lit(" was 5.5"))).otherwise(F.concat(F.lit("5.5 in "), y, F.lit(" compared with much lower readings taken in "), other))
    period = F.when(F.col("o_orderkey") % 3 == 0, other).otherwise(y)
    x = t(spark, sf_dir, "orders").select(quote.alias("quote"), period.alias("period"), F.lit(5.5).alias("value"))
    return repairs.corrected_years(x).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) || ' June' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS period, count(*) AS n FROM orders GROUP BY 1")
def anchored_periods(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("identifier"), F.when(F.col("o_orderkey") % 2 == 0, "June").otherwise(F.year("o_orderdate").cast("string")).alias("period"))
    return repairs.anchored_periods(rows, o.select(F.col("o_orderkey").alias("identifier"), F.year("o_orderdate").alias("year"))).groupBy("period").agg(F.count("*").alias("n"))


@query("SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def folded_months(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM")).otherwise("Elora").alias("place"), F.year("o_orderdate").cast("string").alias("period"), F.to_date("o_orderdate").alias("day"))
    x = records.fold_month(rows).where(F.col("place").isNull() & (F.col("period") == F.date_format("day", "yyyy-MM")))
    return x.groupBy("day").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY 1")
def deduplicated_parts(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    return records.drop_repeats(x, ["l_orderkey", "l_returnflag", "l_linestatus"], "o").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT n_name AS town, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def town_names(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.col("n_name"), pick("c_custkey", "", " WPCP", " Water Works", " Filtration Plant, east"))
    return c.groupBy(town.town_name(name).alias("town")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT o_custkey AS place, max(year(o_orderdate)) + 1 AS since FROM orders GROUP BY 1) SELECT place, CAST(since AS INTEGER) AS silent_since, count(*) OVER (PARTITION BY since) AS same_year FROM x WHERE since <= 1998")
def went_quiet(spark, sf_dir):
    from ledgerline.operators import series
    from ledgerline.plans import views

    x = series.silence(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("place"), F.year("o_orderdate").alias("year")), ["place"], horizon=1998)
    return views.went_quiet(x).select("place", "silent_since", "same_year")


@query("SELECT 'x' AS w, 1 AS n WHERE false")
def vocabulary_errors(spark, sf_dir):
    terms = t(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("canonical")).agg(F.count("*").alias("readings_covered"))
    none = F.array().cast("array<string>")
    terms = terms.select("canonical", F.lit("").alias("substance"), F.lit("").alias("measure"), none.alias("aliases"), none.alias("typical_units"), "readings_covered", F.lit(True).alias("reviewed"))
    return vocabulary.validation_errors(terms).groupBy(F.col("problem").alias("w")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT lower(n_name) AS place, count(DISTINCT year(o_orderdate)) AS n, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def years_of_places(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    x = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    x = tools.years_of(x.select(F.col("n_name").alias("place"), F.date_format("o_orderdate", "yyyy-MM").alias("period")))
    return x.select("place", F.size("years").cast("long").alias("n"), F.get("years", F.lit(0)).alias("first_year"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'ation_1') GROUP BY 1")
def library_lookup(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("place", F.col("n_name"))
    return tools.held(c, " ATION_1 ").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN s_suppkey % 3 = 0 AND s_nationkey % 2 = 0 THEN 'declared tier 0 but requires header auth; tier 0 means keyless' END, CASE WHEN s_suppkey % 3 > 0 THEN 'tier ' || s_suppkey % 3 || ' but no env_var to read a key from' END, CASE WHEN s_nationkey > 15 THEN 'endpoint is not https' END], lambda x: x IS NOT NULL)) AS problem FROM supplier) GROUP BY 1")
def provider_problems(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 3).alias("tier"), F.when(F.col("s_nationkey") > 15, "http://x").otherwise("https://x").alias("endpoint"), F.lit("CC0").alias("licence"), F.when(F.col("s_nationkey") % 2 == 0, "header").otherwise("none").alias("auth_mode"), F.lit("").alias("env_var"))
    return tools.provider_problems(s).groupBy("problem").agg(F.count("*").alias("n"))


@query(f"WITH {SLOT_SQL}, a AS (SELECT slot, count(*) FILTER (WHERE verified) AS verified, count(DISTINCT value) FILTER (WHERE verified) AS v, count(DISTINCT (identifier, page)) FILTER (WHERE verified) AS pages, count(DISTINCT quote) FILTER (WHERE verified) AS quotes FROM sl GROUP BY slot), b AS (SELECT CASE WHEN verified = 0 THEN 'unsupported' WHEN v <= 1 THEN 'settled' WHEN pages = 1 AND quotes = verified THEN 'undistinguished' ELSE 'contested' END AS state FROM a) SELECT count(*) AS slots, count(*) FILTER (WHERE state = 'settled') AS settled, count(*) FILTER (WHERE state = 'contested') AS contested, count(*) FILTER (WHERE state = 'undistinguished') AS undistinguished, count(*) FILTER (WHERE state = 'unsupported') AS unsupported FROM b")
def ledger_report(spark, sf_dir):
    return tools.ledger_report(ledger.slots(standings(spark, sf_dir)))


@query(f"WITH {SLOT_SQL}, a AS (SELECT slot, count(DISTINCT value) AS n_values, count(DISTINCT (identifier, page)) AS pages, count(DISTINCT quote) AS quotes, count(*) AS n FROM sl WHERE verified GROUP BY slot) SELECT slot, n_values, quotes = 1 AS same_sentence FROM a WHERE n_values > 1 AND NOT (pages = 1 AND quotes = n) ORDER BY n_values DESC, slot LIMIT 20")
def disputed_slots(spark, sf_dir):
    return tools.disputed(standings(spark, sf_dir)).select("slot", "n_values", "same_sentence")


def answer_sheet(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A gold page for each line number of an order below four, and a reading of each: every value is its own, kinds and streams of one part in three are wrong."""
    x = t(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    order = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice", "l_shipdate"))
    x = x.withColumn("ord", order.cast("long")).select(F.col("l_orderkey").cast("string").alias("identifier"), F.col("l_linenumber").alias("page"), "ord", (F.lit(10.0) * F.pow(F.lit(2.0), F.col("ord").cast("double"))).alias("value"), F.lit("mg/l").alias("unit"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("stream"), "l_partkey")
    wrong = F.col("l_partkey") % 3 == 0
    got = x.select("identifier", "page", "ord", "value", "unit", F.when(wrong, "none").otherwise(F.col("kind")).alias("kind"), F.when(wrong, "none").otherwise(F.col("stream")).alias("stream"))
    return x.drop("l_partkey"), got


@query("SELECT CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, round(count(*) FILTER (WHERE l_partkey % 3 <> 0) / CAST(count(*) AS DOUBLE), 6) AS kind_accuracy, round(count(*) FILTER (WHERE l_partkey % 3 <> 0) / CAST(count(*) AS DOUBLE), 6) AS stream_accuracy FROM lineitem WHERE l_linenumber <= 3")
def rescored_run(spark, sf_dir):
    totals, _ = tools.rescored(*answer_sheet(spark, sf_dir))
    return totals.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "kind_accuracy", "stream_accuracy")))


@query("SELECT l_returnflag AS gold_kind, 'none' AS got_kind, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 AND l_partkey % 3 = 0 GROUP BY 1")
def kind_confusions(spark, sf_dir):
    return tools.kind_confusions(*answer_sheet(spark, sf_dir))


@query("WITH x AS (SELECT p_type AS canonical, lower(p_brand) AS spelling FROM part) SELECT CASE WHEN canonical = 'STANDARD' THEN 'forestry' ELSE 'unsorted' END AS domain, spelling, canonical FROM x GROUP BY ALL UNION SELECT CASE WHEN canonical = 'STANDARD' THEN 'forestry' ELSE 'unsorted' END, canonical, canonical FROM x")
def applied_reviews(spark, sf_dir):
    p = t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("stem")).agg(F.count("*").alias("n"), F.collect_set("p_brand").alias("variants")).withColumn("units", F.array().cast("array<string>"))
    return tools.applied_review(tools.review_file(p).withColumn("decision", F.lit("keep")))


@query("WITH s AS (SELECT o_custkey AS c, CAST(min(year(o_orderdate)) AS INTEGER) AS f FROM orders GROUP BY 1) SELECT 'c' || c AS place, f AS first_year, c % 2 = 0 AS extracted, CASE WHEN c % 3 = 0 THEN CAST(c AS DOUBLE) END AS lat FROM s")
def silent_municipalities(spark, sf_dir):
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    o = t(spark, sf_dir, "orders")
    silences = o.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_year")).select(name("o_custkey").alias("place"), "first_year")
    c = t(spark, sf_dir, "customer")
    located = c.where("c_custkey % 3 = 0").select(F.upper(name("c_custkey")).alias("place"), F.col("c_custkey").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    read = c.where("c_custkey % 2 = 0").select(name("c_custkey").alias("place"), F.lit("1960").alias("period"))
    return tools.municipalities(silences, located, read).select("place", "first_year", "extracted", "lat")


@query("SELECT p_brand AS stratum, least(3, count(DISTINCT p_name)) AS documents FROM part GROUP BY 1 ORDER BY count(DISTINCT p_name) DESC, p_brand LIMIT 10")
def trial_pages(spark, sf_dir):
    pages = t(spark, sf_dir, "part").select(F.col("p_brand").alias("stratum"), F.col("p_name").alias("identifier"), F.col("p_size").alias("page"))
    return batches.trial_pages(pages, strata=10, documents=3).groupBy("stratum").agg(F.count("*").alias("documents"))


@query("SELECT p_brand AS place, count(*) = count(*) FILTER (WHERE p_size % 7 <> 0) AS complete, count(DISTINCT p_partkey) FILTER (WHERE p_size % 7 = 0) AS missing FROM part GROUP BY 1")
def batch_completion(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("place"), F.col("p_partkey").cast("string").alias("identifier"), "p_size")
    x = batches.complete(p.where("p_size % 7 <> 0").drop("p_size"), p)
    return x.select("place", "complete", F.size("missing").cast("long").alias("missing"))


@query("SELECT p_size % 2 = 0 AS valid, count(*) AS n FROM part GROUP BY 1")
def verbatim_evidence(spark, sf_dir):
    text = F.concat(F.lit("printed in "), "p_name", F.lit(", "), "p_brand")
    said = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(", "), "p_brand")).otherwise(F.upper("p_name"))
    return t(spark, sf_dir, "part").select(batches.guess_is_valid(said, text).alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))


@query("SELECT lower(p_type) AS stem, count(*) AS n, count(DISTINCT p_brand) AS families FROM part GROUP BY 1")
def survey_terms(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.concat(F.lit("Average "), "p_type").alias("parameter"), F.lit(None).cast("string").alias("unit"), F.concat(F.lit("the average "), F.lower("p_type")).alias("source_text"), F.lit("s").alias("stratum"), F.col("p_brand").alias("family"), F.lit(80.0).alias("ocr_confidence"))
    return vocabulary.survey(vocabulary.observed(p)).where("archive_language and not settled and not suspect").select(F.col("term").alias("stem"), "n", "families")



__all__ = ["ORACLES", "QUERIES"]
