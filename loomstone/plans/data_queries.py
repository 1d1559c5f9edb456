"""Queries on vectors, registries, JSON, files and streams, and the relational operators on the star schema."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.functions import vectors
from loomstone.operators import registry as reg
from loomstone.plans.registry import query, table
from loomstone.scratch import scratch_path
from loomstone.sources import jsonl
from loomstone.streaming import ingest

# --- vectors ---------------------------------------------------------------------------------------------------------------
DIMS = "(select label, d, avg(embedding[d]::double) as m from embeddings, range(1, 65) r(d) group by label, d)"
CENTRES = f"c as (select label, list(m order by d) as centre from {DIMS} group by label)"
COS = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::double * {1}[i]::double)) / (sqrt(list_sum(list_transform({0}, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform({1}, lambda x: x::double * x::double))) + 1e-8)"


def centres(spark, sf):
    return vectors.mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding", "centre")


def _scored(spark, sf):
    """Every vector with the centre of its label; there are as many centres as labels."""
    return table(spark, sf, "embeddings").join(centres(spark, sf), "label").withColumn("similarity", vectors.cosine(F.col("embedding"), F.col("centre")))


@query(f"""with {CENTRES}, s as (select vec_id, label, {COS.format('embedding', 'centre')} as similarity from embeddings join c using (label)),
  r as (select *, row_number() over (partition by label order by similarity desc, vec_id) as rank from s) select label, vec_id, rank, round(similarity, 6) as similarity from r where rank <= 20""")
def cluster_topk(spark, sf):
    best = vectors.top_k_per_group(_scored(spark, sf).select("label", "vec_id", "similarity"), ["label"], "similarity", "vec_id", 20)
    return best.select("label", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"""with {CENTRES}, s as (select e.vec_id, c.label, {COS.format('embedding', 'centre')} as similarity from embeddings e cross join c),
  r as (select *, row_number() over (partition by vec_id order by similarity desc, label) as rank from s) select vec_id, label as nearest, round(similarity, 6) as similarity from r where rank = 1""")
def nearest_centroid(spark, sf):
    best = vectors.nearest(table(spark, sf, "embeddings"), "embedding", centres(spark, sf), "label", "centre")
    return best.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@query("with s as (select r.label, count(e.vec_id) as n from range(12) r(label) left join embeddings e on e.label = r.label group by r.label) select min(n) as smallest, max(n) as largest, round(avg(n), 4) as mean_size, count(*) filter (n = 0) as empty from s")
def cluster_sizes(spark, sf):
    """Sizes of twelve clusters, of which the labels fill some: empty ones count."""
    sizes = table(spark, sf, "embeddings").groupBy(F.col("label").cast("bigint").alias("id")).agg(F.count("*").alias("n"))
    every = spark.range(12).join(sizes, "id", "left").na.fill({"n": 0})
    return every.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 4).alias("mean_size"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"))


@query("select r.label as cluster from range(12) r(label) where r.label not in (select label from embeddings where label is not null)")
def empty_clusters(spark, sf):
    return spark.range(12).join(table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("id")), "id", "left_anti").select(F.col("id").alias("cluster"))


NEAR = 0.45
PAIRS = f"select a.vec_id as id_a, b.vec_id as id_b from embeddings a join embeddings b on a.vec_id < b.vec_id where {COS.format('a.embedding', 'b.embedding')} > {NEAR}"


@query(PAIRS)
def near_dup_pairs(spark, sf):
    return vectors.similar_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", NEAR).select("id_a", "id_b")


@query()
def dedup_greedy(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 101).alias("confidence"))
    pairs = vectors.similar_pairs(rows, "vec_id", "embedding", NEAR)
    return vectors.greedy_keep(rows, "vec_id", "confidence", pairs).select("vec_id", "confidence")


@query()
def kmeans_fit(spark, sf):
    """Clusters by k-means‖ over all vectors: size of each cluster and mean distance within."""
    rows = table(spark, sf, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=16, seed=42, maxIter=20).fit(rows)
    centres_df = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    placed = model.transform(rows).join(F.broadcast(centres_df), "prediction")
    gap = F.zip_with(vector_to_array("features"), F.col("centre"), lambda a, b: (a - b) * (a - b))
    return placed.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))), 4).alias("mean_distance"))


@query(f"""with {CENTRES}, own as (select avg({COS.format('embedding', 'centre')}) as m from embeddings join c using (label)),
  other as (select avg({COS.format('embedding', 'centre')}) as m from embeddings e join c on c.label = (e.label + 1) % 10)
  select round(own.m, 6) as own, round(other.m, 6) as other, own.m > other.m as sane from own, other""")
def sanity_cosine(spark, sf):
    other = table(spark, sf, "embeddings").join(centres(spark, sf).withColumnRenamed("label", "l2"), F.col("l2") == (F.col("label") + 1) % 10)
    own = _scored(spark, sf).agg(F.avg("similarity").alias("a"))
    far = other.agg(F.avg(vectors.cosine(F.col("embedding"), F.col("centre"))).alias("b"))
    return own.crossJoin(far).select(F.round("a", 6).alias("own"), F.round("b", 6).alias("other"), (F.col("a") > F.col("b")).alias("sane"))


@query("select vec_id, case when vec_id % 3 = 0 then 'mean' else 'own' end as kind, round(case when vec_id % 3 = 0 then list_avg(list_transform(embedding, lambda x: x::double)) else embedding[1]::double end, 6) as head from embeddings")
def vector_fallback(spark, sf):
    """A vector of the wrong length gives way to the constant vector of the mean of its row."""
    cut = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("embedding")
    good = F.size(cut) == F.size("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.when(good, "own").otherwise("mean").alias("kind"), F.round(F.when(good, F.get(cut, F.lit(0)).cast("double")).otherwise(mean), 6).alias("head"))


@query("select e.vec_id, e.label, 's' || (e.vec_id // 10) as sentence, e.vec_id % 10 as pos from embeddings e where e.vec_id % 10 <> 9")
def vector_meta_join(spark, sf):
    """Vectors joined with the description of their rows on an explicit id; masked positions (9) are left out first."""
    meta = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("s"), F.floor(F.col("vec_id") / 10).cast("string")).alias("sentence"), (F.col("vec_id") % 10).alias("pos"))
    return table(spark, sf, "embeddings").select("vec_id", "label").join(meta.where("pos <> 9"), "vec_id")


# --- registries ------------------------------------------------------------------------------------------------------------
LAST = "last as (select symbol, arity, domain_types, range_type from (select *, row_number() over (partition by symbol order by pos desc) as r from signatures) where r = 1)"


@query(f"with {LAST} select symbol, arity, array_to_string(domain_types, ';') as domain, range_type from last")
def last_wins(spark, sf):
    rows = reg.last_wins(table(spark, sf, "signatures"), ["symbol"], "pos")
    return rows.select("symbol", "arity", F.array_join("domain_types", ";").alias("domain"), "range_type")


@query(f"""with {LAST} select symbol, arity, 'kept' as origin from last union all
  select symbol, arity, origin from (values ('ARITH_ADD', 9, 'new'), ('LOGICAL_XOR', 2, 'new'), ('GIVEN', 1, 'new')) v(symbol, arity, origin) where symbol not in (select symbol from last)""")
def merge_insert_absent(spark, sf):
    have = reg.last_wins(table(spark, sf, "signatures"), ["symbol"], "pos").select("symbol", "arity", F.lit("kept").alias("origin"))
    new = spark.createDataFrame([("ARITH_ADD", 9, "new"), ("LOGICAL_XOR", 2, "new"), ("GIVEN", 1, "new")], "symbol string, arity int, origin string")
    return reg.insert_if_absent(have, new, "symbol")


@query(f"with {LAST} select symbol, case symbol when 'ARITH_ADD' then 3 else arity end as arity, case symbol when 'THEREFORE' then 'Logical' else range_type end as range_type from last")
def override_update(spark, sf):
    have = reg.last_wins(table(spark, sf, "signatures"), ["symbol"], "pos").select("symbol", "arity", "range_type")
    changes = spark.createDataFrame([("ARITH_ADD", 3, None), ("THEREFORE", None, "Logical")], "symbol string, arity int, range_type string")
    return reg.override(have, changes, "symbol")


@query(f"""with {LAST} select symbol, arity, range_type from last union all
  select distinct symbol, 2, 'Relation' from primitives where prim_type in ('Relation', 'Process', 'Logical', 'Modal') and symbol is not null and symbol not in (select symbol from last)""")
def fill_missing_signatures(spark, sf):
    have = reg.last_wins(table(spark, sf, "signatures"), ["symbol"], "pos")
    return reg.fill_signatures(have, table(spark, sf, "primitives")).select("symbol", "arity", "range_type")


# Fixed values, written out here for SQL, not read from the operator's own tables: tops, first subtypes, subtypes, forced paths, dropped symbols.
_TOPS = "'Entity', 'Relation', 'Property', 'Process', 'Logical', 'Numeric', 'Modal'"
_FIRST = "when 'Entity' then 'ConcreteEntity' when 'Relation' then 'CausalRelation' when 'Property' then 'NumericProperty' when 'Process' then 'CognitiveProcess' when 'Logical' then 'Quantifier' when 'Numeric' then 'Cardinal' when 'Modal' then 'Epistemic'"
_SUBS = """'ConcreteEntity', 'AbstractEntity', 'CausalRelation', 'TemporalRelation', 'SpatialRelation', 'LogicalRelation', 'NumericProperty', 'QualitativeProperty',
  'CognitiveProcess', 'PhysicalProcess', 'Quantifier', 'Connective', 'Comparator', 'Cardinal', 'Ordinal', 'Operator', 'Epistemic', 'Deontic'"""
_FORCED = """case when symbol in ('ARITH_ADD', 'ARITH_SUBTRACT', 'ARITH_MULTIPLY', 'ARITH_DIVIDE', 'ARITH_EQUALS', 'ARITH_MODULO') then ['Numeric', 'NumericProperty']
  when symbol in ('LOGICAL_AND', 'LOGICAL_OR', 'LOGICAL_NOT', 'LOGICAL_IMPLIES', 'LOGICAL_IFF', 'LOGICAL_XOR', 'THEREFORE', 'BECAUSE', 'ASSUMES', 'GIVEN') then ['Logical', 'Connective']
  when symbol in ('FORALL', 'EXISTS', 'EXISTS_UNIQUE') then ['Logical', 'Quantifier'] when symbol = 'CONTRADICTS' then ['Logical', 'Comparator']
  when symbol in ('KNOWN_TRUE', 'BELIEVED_TRUE', 'UNCERTAIN', 'KNOWN_FALSE') then ['Modal', 'Epistemic']
  when symbol in ('CAUSAL_ENABLES', 'CAUSAL_PREVENTS', 'CAUSAL_REQUIRES', 'CAUSAL_CONTRIBUTES') then ['Relation', 'CausalRelation']
  when symbol in ('TEMPORAL_BEFORE', 'TEMPORAL_AFTER', 'TEMPORAL_DURING', 'TEMPORAL_UNTIL') then ['Relation', 'TemporalRelation']
  when symbol in ('IS_INSTANCE_OF', 'IS_PART_OF', 'IS_DEFINED_AS', 'IS_EQUIVALENT_TO', 'IS_GREATER_THAN', 'IS_LESS_THAN', 'IS_OPPOSITE_OF') then ['Relation', 'LogicalRelation'] end"""
_DROPPED = "'SEMANTIC_VAGUE', 'UNCLEAR_REQUEST', 'QUASAR_OR_QUARTIC', 'CONTEXTUAL_INCONSISTENCY', 'CONTEXTUAL_WITH_PHRASE', 'ABSTRACT_SYMBOL', 'COMMON_CONCEPT_EXAMPLE', 'STANDARD_CONCEPT'"
FIRSTS = f"case prim_type {_FIRST} else 'Unknown' end"


@query(f"""select symbol, array_to_string(case when length(symbol) % 5 = 0 and reclassify in ({_TOPS}) then [reclassify] else [prim_type, {FIRSTS}] end, '/') as path
  from (select symbol, prim_type, case when length(symbol) % 5 = 0 then case when length(symbol) % 2 = 0 then 'Modal' else 'Nonsense' end end as reclassify from primitives where prim_type is not null)""")
def type_path_derive(spark, sf):
    n = F.length("symbol")
    reclassify = F.when(n % 5 == 0, F.when(n % 2 == 0, "Modal").otherwise("Nonsense"))
    rows = table(spark, sf, "primitives").where("prim_type is not null")
    return rows.select("symbol", F.array_join(reg.derive_type_path(F.col("prim_type"), F.lit(None).cast("string"), reclassify), "/").alias("path"))


NORMAL_PATH = f"""coalesce({_FORCED}, case when type_path is null or len(type_path) = 0 then [prim_type] when type_path[1] not in ({_TOPS}) or len(type_path) = 1 or type_path[2] in ({_SUBS}) then type_path
  else [type_path[1], case type_path[1] {_FIRST} end] end)"""


@query(f"select symbol, array_to_string({NORMAL_PATH}, '/') as path from primitives where symbol not in ({_DROPPED})")
def type_path_normalise(spark, sf):
    rows = table(spark, sf, "primitives").where(~F.col("symbol").isin(*reg.DROPPED))
    return rows.select("symbol", F.array_join(reg.normalise_type_path(F.col("symbol"), F.col("prim_type"), F.col("type_path")), "/").alias("path"))


@query(f"select node, count(*) as n from (select unnest(type_path) as node from primitives) where node not in ({_TOPS}, {_SUBS}) group by node")
def type_path_audit(spark, sf):
    return reg.unknown_path_nodes(table(spark, sf, "primitives"), "type_path")


@query("select array_to_string(type_path, '/') as path, count(*) as n from primitives group by 1")
def type_path_counts(spark, sf):
    return table(spark, sf, "primitives").groupBy("type_path").agg(F.count("*").alias("n")).select(F.array_join("type_path", "/").alias("path"), "n")


@query("select symbol, prim_type, confidence from primitives where confidence >= 0.6 and prim_type in ('Entity', 'Relation', 'Property', 'Process', 'Logical', 'Numeric', 'Modal') and symbol is not null and gloss is not null")
def record_validation(spark, sf):
    """Primitives as JSON texts, read back and held against what a record must have."""
    said = table(spark, sf, "primitives").select(F.to_json(F.struct("symbol", "prim_type", "gloss", "confidence")).alias("j"))
    r = said.select(F.from_json("j", "symbol string, prim_type string, gloss string, confidence double").alias("r")).select("r.*")
    return r.where(F.col("prim_type").isin(*reg.HIERARCHY) & (F.col("confidence") >= 0.6) & F.col("symbol").isNotNull() & F.col("gloss").isNotNull()).select("symbol", "prim_type", "confidence")


@query("select prim_type, round(avg(confidence), 6) as mean_confidence, avg(confidence) < 0.65 as low from primitives group by prim_type")
def confidence_gate(spark, sf):
    return table(spark, sf, "primitives").groupBy("prim_type").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), (F.avg("confidence") < 0.65).alias("low"))


@query("select symbol, prim_type from primitives where symbol not in ('ARITH_ADD', 'THEREFORE', 'LOGICAL_NOT')")
def deny_list(spark, sf):
    denied = spark.createDataFrame([(s,) for s in ("ARITH_ADD", "THEREFORE", "LOGICAL_NOT")], "symbol string")
    return table(spark, sf, "primitives").where("symbol is not null").join(F.broadcast(denied), "symbol", "left_anti").select("symbol", "prim_type")


@query("select symbol, count(*) as n from signatures where symbol like 'ARITH!_%' escape '!' or symbol like 'TEMPORAL!_%' escape '!' or symbol like 'NUMERIC!_%' escape '!' group by symbol")
def prefix_listing(spark, sf):
    s = F.col("symbol")
    return table(spark, sf, "signatures").where(s.startswith("ARITH_") | s.startswith("TEMPORAL_") | s.startswith("NUMERIC_")).groupBy("symbol").agg(F.count("*").alias("n"))


@query("""with m as (select max(try_cast(substr(prim_id, 2) as int)) as m from primitives) select printf('P%04d', m + r) as prim_id, symbol from (select symbol, row_number() over (order by symbol) as r from (values ('NEW_A'), ('NEW_B'), ('NEW_C')) v(symbol)), m""")
def registry_rows(spark, sf):
    new = spark.createDataFrame([("NEW_B",), ("NEW_A",), ("NEW_C",)], "symbol string")
    return reg.next_ids(table(spark, sf, "primitives"), new, "prim_id", "symbol").select("prim_id", "symbol")


@query("select upper(replace(p_name, ' ', '_')) as symbol, max(p_size) as size, substr(max(p_type), 1, 10) as kind from part group by 1")
def symbol_normalise(spark, sf):
    return table(spark, sf, "part").groupBy(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("symbol")).agg(F.max("p_size").alias("size"), F.substring(F.max("p_type"), 1, 10).alias("kind"))


@query("select distinct symbol from (select symbol from primitives where symbol is not null union all select unnest(['ARITH_ADD', 'NUMERIC_RESULT', 'RUNNING_TOTAL']))")
def vocab_add_missing(spark, sf):
    new = spark.createDataFrame([(s,) for s in ("ARITH_ADD", "NUMERIC_RESULT", "RUNNING_TOTAL")], "symbol string")
    return reg.insert_if_absent(table(spark, sf, "primitives").where("symbol is not null").select("symbol").distinct(), new, "symbol")


@query("""select v.symbol, v.symbol in (select symbol from primitives where symbol is not null) as in_primitives, v.symbol in (select symbol from signatures) as in_signatures from (values ('ARITH_ADD'), ('THEREFORE'), ('GIVEN'), ('WEEKLY_APPLES_COUNT')) v(symbol)""")
def existence_probe(spark, sf):
    asked = spark.createDataFrame([(s,) for s in ("ARITH_ADD", "THEREFORE", "GIVEN", "WEEKLY_APPLES_COUNT")], "symbol string")
    one = lambda name, flag: table(spark, sf, name).where("symbol is not null").select("symbol").distinct().withColumn(flag, F.lit(True))
    return asked.join(one("primitives", "in_primitives"), "symbol", "left").join(one("signatures", "in_signatures"), "symbol", "left").na.fill(False)


# --- JSON and files ----------------------------------------------------------------------------------------------------------
@query("select event_type, sum(cast(json_extract(props, '$.k') as bigint))::bigint as k, count(*) as n from events group by event_type")
def json_props(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("select line_id, json_extract_string(raw_line, '$.question') as question, json_extract_string(raw_line, '$.answer') as answer from corpus_lines where json_valid(raw_line) and json_type(raw_line) = 'OBJECT'")
def jsonl_malformed_skip(spark, sf):
    rows = jsonl.lines_to_rows(table(spark, sf, "corpus_lines"), "raw_line", "question string, answer string", ["line_id"])
    return rows.where("readable").select("line_id", "question", "answer")


@query("select o_orderkey, o_orderpriority, o_totalprice from orders")
def jsonl_roundtrip(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = scratch_path(spark, "orders-jsonl")
    jsonl.overwrite(rows, path)
    return jsonl.read_strict(spark, path, rows.schema)


@query("select n_nationkey, n_name from nation")
def json_array_scan(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    path = scratch_path(spark, "nation-json")
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).coalesce(1).write.text(path)
    return jsonl.read_array(spark, path, rows.schema)


@query("select r_regionkey, upper(r_name) as r_name from region")
def overwrite_then_read(spark, sf):
    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    path = scratch_path(spark, "region-jsonl")
    jsonl.overwrite(rows, path)
    jsonl.append(rows.limit(0), path)
    jsonl.overwrite(rows.withColumn("r_name", F.upper("r_name")), path)
    return jsonl.read_lenient(spark, path, rows.schema)


@query("select key, value from (values ('total', 2), ('kept', 3), ('new', 4)) v(key, value)")
def stats_merge(spark, sf):
    old = spark.createDataFrame([("total", 1), ("kept", 3)], "key string, value int")
    return jsonl.merge_stats(old, spark.createDataFrame([("total", 2), ("new", 4)], "key string, value int"))


@query("select doc_id, substr(text, 1, 512) as text from documents where source = 'chain_notes' order by doc_id limit 200")
def source_filter_limit(spark, sf):
    return table(spark, sf, "documents").where("source = 'chain_notes'").select("doc_id", F.substring("text", 1, 512).alias("text")).orderBy("doc_id").limit(200)


@query("select n_name as name from nation union all select r_name from region")
def source_fallback(spark, sf):
    first = jsonl.first_that_reads([lambda: table(spark, sf, "no_such_table"), lambda: table(spark, sf, "nation").select(F.col("n_name").alias("name"))])
    return first.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name")))


# --- streams -----------------------------------------------------------------------------------------------------------------
def _events_folder(spark, sf):
    return f"{sf}/events.parquet"


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
def stream_ingest(spark, sf):
    """Events taken in as a file stream; a second run finds nothing new and adds nothing."""
    source, target, checkpoint = scratch_path(spark, "events-source"), scratch_path(spark, "events-target"), scratch_path(spark, "events-checkpoint")
    events = table(spark, sf, "events")
    events.write.parquet(source)
    for _ in range(2):
        rows = ingest.ingest_once(spark, source, events.schema, target, checkpoint)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select user_id, 1::bigint as n from (select distinct user_id from events)")
def incremental_new_keys(spark, sf):
    source, target, checkpoint = scratch_path(spark, "keys-source"), scratch_path(spark, "keys-target"), scratch_path(spark, "keys-checkpoint")
    users = table(spark, sf, "events").select("user_id")
    for _ in range(2):
        users.write.mode("append").parquet(source)
        rows = ingest.ingest_new_keys(spark, source, users.schema, target, checkpoint, "user_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""select start, event_type, n from (select date_trunc('hour', ts) as start, event_type, count(*) as n from events where ts is not null group by all)
  where start + interval 1 hour <= (select max(ts) from events) - interval 1 day""")
def stream_windowed_counts(spark, sf):
    """Windows over a file stream: a window is written when the watermark, a day behind the latest event, has passed its end."""
    source, target, checkpoint = (scratch_path(spark, f"windows-{n}") for n in ("source", "target", "checkpoint"))
    events = table(spark, sf, "events").select("ts", "event_type")
    events.write.parquet(source)
    return ingest.ingest_once(spark, source, events.schema, target, checkpoint, transform=lambda s: ingest.windowed_counts(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("select upper(raw_line) as line, count(*)::bigint as n from (select unnest(string_split(regexp_replace(raw_line, '\\r\\n|\\r', chr(10), 'g'), chr(10))) as raw_line from corpus_lines where raw_line is not null) group by 1")
def text_scan(spark, sf):
    """Lines written as text and read again; a line that holds line breaks comes back as several."""
    path = scratch_path(spark, "lines")
    table(spark, sf, "corpus_lines").where("raw_line is not null").select("raw_line").write.text(path)
    return jsonl.read_text(spark, path).groupBy(F.upper("value").alias("line")).agg(F.count("*").alias("n"))


@query("select n_nationkey, n_name, 2::bigint as n from nation")
def append_twice(spark, sf):
    """A sink that is only added to: what is appended twice is there twice."""
    path = scratch_path(spark, "appended")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    for _ in range(2):
        jsonl.append(rows, path)
    return jsonl.read_strict(spark, path, rows.schema).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("n"))


@query("select count(*) as orders, round(sum(o_totalprice), 2) as total, count(*) > 0 as flagged from orders")
def document_sink(spark, sf):
    """Sums written as one indented JSON document; the conditional sink writes since a row is flagged."""
    path, other = scratch_path(spark, "document"), scratch_path(spark, "conditional")
    orders = table(spark, sf, "orders")
    jsonl.write_document(orders.agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")), path)
    wrote = jsonl.write_if_any(orders.select("o_orderkey", (F.col("o_totalprice") > 0).alias("bad")), "bad", other)
    return spark.read.option("multiLine", True).schema("orders bigint, total double").json(path).withColumn("flagged", F.lit(wrote))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def windowed_counts(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


# --- relational operators on the star schema (beyond what the corpus tools need) -----------------------------------------------
@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as mean_discount, count(*) as n
  from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("""select n_name, o_orderpriority, grouping(n_name) + 2 * grouping(o_orderpriority) as level, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (o_orderpriority, n_name)""")
def orders_rollup(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("o_orderpriority", "n_name").agg(F.count("*").alias("n"), (F.grouping("n_name") + 2 * F.grouping("o_orderpriority")).cast("bigint").alias("level"))


@query("""select e.event_id, (select max(p.event_id) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and (p.ts < e.ts or (p.ts = e.ts and p.event_id <= e.event_id)) and p.ts = (select max(q.ts) from events q where q.user_id = e.user_id and q.event_type = 'purchase' and (q.ts < e.ts or (q.ts = e.ts and q.event_id <= e.event_id)))) as last_purchase
  from events e where e.event_type = 'view'""")
def as_of_purchase(spark, sf):
    """The last purchase of the user at or before each view, by one window over both (an as-of join without a join)."""
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return table(spark, sf, "events").select("event_id", "event_type", held.alias("last_purchase")).where("event_type = 'view'").select("event_id", "last_purchase")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minute then 0 else 1 end as new from events where ts is not null)
  select user_id, sum(new)::bigint as sessions, count(*) as n from g group by user_id""")
def user_sessions(spark, sf):
    """Sessions end after 30 minutes without an event."""
    prev = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts"))
    new = F.when(F.col("ts") - prev <= F.expr("interval 30 minutes"), 0).otherwise(1)
    return table(spark, sf, "events").where("ts is not null").select("user_id", new.alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))


# --- the SQL surface, models and matrices ----------------------------------------------------------------------------------------
@query(f"""with a as (select corpus_id, coalesce(nullif(regexp_extract(answer, '[0-9]+'), ''), '0') as n from corpus)
  select corpus_id, '(ARITH_EQUALS #x ' || n || ')' as repaired, 3::bigint as nodes from a""")
def sql_surface(spark, sf):
    """Scalar and table functions called from SQL, on an equation from the first number of each answer (0 where there is none)."""
    from loomstone.functions.register import register

    register(spark, table(spark, sf, "signatures"))
    n = F.coalesce(F.nullif(F.regexp_extract("answer", "[0-9]+", 0), F.lit("")), F.lit("0"))
    table(spark, sf, "corpus", python=True).select("corpus_id", F.concat(F.lit("ARITH_EQUALS #x "), n).alias("bare")).createOrReplaceTempView("loomstone_bare")
    return spark.sql("""with fixed as (select corpus_id, auto_repair(bare) as repaired from loomstone_bare)
      select f.corpus_id, f.repaired, count(*) as nodes from fixed f, lateral parse_nodes(f.repaired) n group by f.corpus_id, f.repaired""")


@query(r"""select count(*) filter (regexp_matches(answer, '^[0-9]{1,9}$')) as whole_numbers, count(*) filter (regexp_matches(answer, '^[0-9]{1,9}$')) as scored, count(*) as rows_read,
  round((select avg(embedding[1]::double) from embeddings), 4) as mean_first from corpus""")
def sql_scores(spark, sf):
    """normalize_answer, score_answer and vector_mean called from SQL."""
    from loomstone.functions.register import register

    register(spark, table(spark, sf, "signatures"))
    table(spark, sf, "corpus").select("answer").createOrReplaceTempView("loomstone_answers")
    table(spark, sf, "embeddings").select("embedding").createOrReplaceTempView("loomstone_vectors")
    return spark.sql(r"""with n as (select answer, answer rlike '^[0-9]{1,9}$' as whole, normalize_answer(answer) as t from loomstone_answers),
        c as (select count_if(whole and cast(t as bigint) = cast(answer as bigint)) as whole_numbers, count_if(whole and score_answer(concat('$', answer, '.0'), answer)) as scored, count(*) as rows_read from n),
        v as (select vector_mean(embedding) as m from loomstone_vectors)
      select whole_numbers, scored, rows_read, round(m[0], 4) as mean_first from c cross join v""")


@query()
def sql_surface_all(spark, sf):
    """Every chain of the corpus repaired and read from SQL: the nodes as it is and repaired, 0 where it can't be read."""
    from loomstone.functions.register import register

    register(spark, table(spark, sf, "signatures"))
    table(spark, sf, "corpus", python=True).select("corpus_id", "neuralese_chain").createOrReplaceTempView("loomstone_chains")
    return spark.sql("""with texts as (select corpus_id, 0 as fixed, neuralese_chain as chain from loomstone_chains
        union all select corpus_id, 1 as fixed, auto_repair(neuralese_chain) as chain from loomstone_chains),
      marked as (select corpus_id, fixed, chain, 0 as nodes from texts union all select t.corpus_id, t.fixed, null as chain, 1 as nodes from texts t, lateral parse_nodes(t.chain) n)
      select corpus_id, max(case when fixed = 1 then chain end) as repaired, sum(case when fixed = 0 then nodes end) as nodes, sum(case when fixed = 1 then nodes end) as repaired_nodes
      from marked group by corpus_id""")


@query()
def model_labels(spark, sf):
    """Clusters named by the stand-in model from the tokens (here ids) nearest to their centres."""
    from loomstone.plans import mining

    near = vectors.top_k_per_group(_scored(spark, sf).select("label", "vec_id", "similarity"), ["label"], "similarity", "vec_id", 20)
    rows = near.select(F.col("label").alias("cluster_id"), "rank", F.concat(F.lit("tok"), F.col("vec_id").cast("string")).alias("token"))
    return mining.label_clusters(rows, mining.rule_model).select("prim_id", "symbol", "prim_type", "confidence")


@query()
def model_types(spark, sf):
    from loomstone.plans import mining

    return mining.structure_types(table(spark, sf, "primitives"), mining.rule_model).select("symbol", F.array_join("type_path", "/").alias("path"), "reclassified")


@query()
def model_signatures(spark, sf):
    from loomstone.plans import mining

    have = reg.last_wins(table(spark, sf, "signatures"), ["symbol"], "pos").where("symbol not like 'LOGICAL%'")
    return mining.write_signatures(table(spark, sf, "primitives"), have, mining.rule_model).select("symbol", "arity", "range_type")


@query("select least(count(*), 200) || ' symbols shown' as said from primitives where symbol is not null")
def model_gaps(spark, sf):
    from loomstone.plans import mining

    return mining.grammar_gaps(table(spark, sf, "primitives"), mining.rule_model)


@query("select p.prim_id, p.symbol, e.label from (select distinct prim_id, symbol, try_cast(substr(prim_id, 2) as bigint) as i from primitives where prim_id like 'P%') p join embeddings e on e.vec_id = p.i")
def centroid_rows(spark, sf):
    """Registry rows with a usable centre: an id P<n> whose n is a row of the matrix."""
    ids = table(spark, sf, "primitives").where("prim_id like 'P%'").select("prim_id", "symbol", F.expr("try_cast(substring(prim_id, 2, 9) as bigint)").alias("vec_id")).distinct()
    return ids.join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id").select("prim_id", "symbol", "label")


@query("select symbol, len(string_split(symbol, '_')) as pieces from primitives where symbol is not null and len(string_split(symbol, '_')) <> 1")
def atomicity_check(spark, sf):
    """Vocabulary entries that an encoding cuts into several pieces; here pieces end at underscores."""
    rows = table(spark, sf, "primitives").where("symbol is not null").select("symbol", F.size(F.split("symbol", "_")).cast("bigint").alias("pieces"))
    return rows.where("pieces <> 1")
