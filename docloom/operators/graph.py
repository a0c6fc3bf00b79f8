"""Entity graph: building, merging, traversal and facts.

Vertices and edges are tables. Traversal is a loop of frontier joins whose
length is the number of hops, not the size of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom import lexicon as lx
from docloom.functions import text as tx
from docloom.session import checkpoint_ready, materialize

# Limits of extraction, traversal and facts.
MAX_NAME_CHARS = 50
MIN_EXTRACT_CHARS = 20
MAX_HOPS, MAX_NODES, MAX_FACTS = 3, 50, 30

EXTRACTION_SCHEMA = (
    "struct<entities:array<struct<name:string,type:string,description:string>>,"
    "relations:array<struct<source:string,target:string,relation_type:string,relation:string,"
    "description:string,weight:double>>>"
)


# --- extraction ----------------------------------------------------------------------
def term_graph(col) -> Column:
    """Model-free extractor: distinct keywords as entities, each one related to the
    next in reading order, as an extraction already parsed."""

    def linked(words: Column) -> Column:
        entities = F.transform(
            words, lambda w: F.struct(w.alias("name"), F.lit("term").alias("type"), F.lit("").alias("description"))
        )
        relations = F.zip_with(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
            F.slice(words, F.lit(2), F.size(words)),
            lambda a, b: F.struct(
                a.alias("source"), b.alias("target"), F.lit("next").alias("relation_type"),
                F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("description"), F.lit(1.0).alias("weight"),
            ),
        )
        return F.struct(entities.alias("entities"), relations.alias("relations"))

    return tx.bind(tx.keywords(col), linked)


def term_chain(col) -> Column:
    """The same as the JSON an extraction model would return."""
    return F.to_json(term_graph(col))


def extract(chunks: DataFrame, extractor=term_chain, text: str = "content", max_chars: int | None = None) -> DataFrame:
    """Adds ``raw``, the extractor's JSON (or what it parses to, if the extractor returns
    that), for chunks of at least 20 characters. An extractor with a limited context gets the first ``max_chars`` characters of a chunk."""
    shown = tx.strip(text) if max_chars is None else F.substring(tx.strip(text), 1, max_chars)
    long_enough = F.length(tx.strip(text)) >= MIN_EXTRACT_CHARS
    return chunks.withColumn("raw", extractor(F.when(long_enough, shown)))


_ENTITY = "array<struct<name:string,type:string,description:string>>"
_RELATION = (
    "array<struct<source:string,target:string,relation_type:string,relation:string,"
    "description:string,weight:double>>"
)


def _named(entities: Column) -> Column:
    cleaned = F.transform(
        F.coalesce(entities, F.array().cast(_ENTITY)),
        lambda e: F.struct(
            tx.strip(F.coalesce(e["name"], F.lit(""))).alias("name"),
            F.coalesce(e["type"], F.lit("concept")).alias("type"),
            F.coalesce(e["description"], F.lit("")).alias("description"),
        ),
    )
    return F.filter(cleaned, lambda e: (e["name"] != "") & (F.length(e["name"]) <= MAX_NAME_CHARS))


def _linked(relations: Column, names: Column) -> Column:
    cleaned = F.transform(
        F.coalesce(relations, F.array().cast(_RELATION)),
        lambda r: F.struct(
            tx.strip(F.coalesce(r["source"], F.lit(""))).alias("source"),
            tx.strip(F.coalesce(r["target"], F.lit(""))).alias("target"),
            tx.strip(F.coalesce(F.nullif(r["relation_type"], F.lit("")), r["relation"], F.lit(""))).alias("relation_type"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["weight"], F.lit(1.0)))).alias("weight"),
        ),
    )

    def known(rs: Column) -> Column:
        ends = F.concat(*[F.transform(rs, lambda r: r[end]) for end in ("source", "target")])
        # A set difference is linear; most relations have no unknown end to look for.
        return tx.bind(
            F.array_except(ends, names),
            lambda unknown: F.filter(
                rs,
                lambda r: (r["relation_type"] != "")
                & ((F.size(unknown) == 0) | ~(F.array_contains(unknown, r["source"]) | F.array_contains(unknown, r["target"]))),
            ),
        )

    return tx.bind(cleaned, known)


def validate(extracted: DataFrame, raw: str = "raw", relations: bool = True) -> DataFrame:
    """Parsed extraction: entities with a name of 1-50 characters, relations
    between extracted entities only, weights clamped to [0, 1]. ``raw`` is JSON or
    parsed already. Without ``relations`` only entities are read."""
    parsed = isinstance(extracted.schema[raw].dataType, T.StructType)
    if not relations:
        graph = F.col(raw) if parsed else F.from_json(raw, f"struct<entities:{_ENTITY}>")
        return extracted.withColumn("entities", tx.bind(graph, lambda graph: _named(graph["entities"])))

    def checked(graph: Column) -> Column:
        return tx.bind(
            _named(graph["entities"]),
            lambda es: tx.bind(
                F.transform(es, lambda e: e["name"]),
                lambda names: F.struct(
                    es.alias("entities"), _linked(graph["relations"], names).alias("relations")
                ),
            ),
        )

    return extracted.withColumn("_v", tx.bind(F.col(raw) if parsed else F.from_json(raw, EXTRACTION_SCHEMA), checked)).select(
        *extracted.columns, "_v.entities", "_v.relations"
    )


def entities_of(validated: DataFrame) -> DataFrame:
    return validated.select(
        F.explode("entities").alias("e"), "doc_id", "chunk_id"
    ).select("e.name", "e.type", "e.description", "doc_id", "chunk_id")


def relations_of(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("relations").alias("r")).select("r.*")


# --- building --------------------------------------------------------------------------
def merge_entities(mentions: DataFrame, order: str = "chunk_id") -> DataFrame:
    """One vertex per name: type of the first mention, first non-empty description,
    and how many documents and chunks mention it.

    A chunk belongs to one document. Memberships stay rows (``entity_membership``): a
    name found in a third of the corpus would not fit one array.
    """
    described = lambda at, text: F.min(F.when(text != "", F.struct(at.alias("at"), text.alias("text"))))
    # Mentions are shuffled once, by name and document; names get one row a document.
    dealt = mentions.repartition("name", "doc_id")
    by_chunk = dealt.groupBy("name", "doc_id", "chunk_id").agg(
        F.min_by(F.struct(F.col(order).alias("at"), "type"), order).alias("t"),
        described(F.col(order), F.col("description")).alias("d"),
    )
    first, described = F.min_by("t", F.col("t.at")), F.min("d")
    by_doc = by_chunk.groupBy("name", "doc_id").agg(first.alias("t"), described.alias("d"), F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("name").agg(
        first["type"].alias("type"), F.coalesce(described["text"], F.lit("")).alias("description"),
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"),
    )


def entity_membership(mentions: DataFrame) -> DataFrame:
    return mentions.select("name", "doc_id", "chunk_id").distinct()


def both_directions(relations: DataFrame) -> DataFrame:
    """Adjacency rows: every relation from its source and from its target."""
    forward = relations.select(F.col("source").alias("name"), "relation_type", F.col("target").alias("neighbour"))
    backward = relations.select(F.col("target").alias("name"), "relation_type", F.col("source").alias("neighbour"))
    return forward.unionByName(backward)


def graph_stats(vertices: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities per type, all entities (type '*') and all relations ('relations')."""
    per_type = vertices.groupBy("type").agg(F.count("*").alias("n"))
    total = vertices.agg(F.count("*").alias("n")).select(F.lit("*").alias("type"), "n")
    links = relations.agg(F.count("*").alias("n")).select(F.lit("relations").alias("type"), "n")
    return per_type.unionByName(total).unionByName(links)


# --- traversal -----------------------------------------------------------------------------
def multi_hop(seeds: DataFrame, relations: DataFrame, vertices: DataFrame | None = None, hops: int = MAX_HOPS,
              max_nodes: int | None = MAX_NODES) -> DataFrame:
    """query_id, name, depth: vertices within ``hops`` of the seeds, start included.

    Breadth first; among equally deep vertices the one first in name order. With a
    node limit every hop keeps at most that many new vertices per query, which
    changes nothing in the result (nearer vertices come first) and bounds the
    frontier. Neighbours are deduplicated per query before they grow the result.
    """
    start = seeds.select("query_id", "name").distinct().withColumn("depth", F.lit(0))
    if vertices is not None:
        start = start.join(vertices.select("name"), "name", "left_semi").select("query_id", "name", "depth")
    links = both_directions(relations).select("name", "neighbour").distinct()
    if max_nodes is not None:
        # A vertex contributes at most max_nodes + visited names to any query; the
        # visited ones number at most max_nodes, so twice the limit is enough.
        w = Window.partitionBy("name").orderBy("neighbour")
        links = links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2 * max_nodes).drop("_rn")
    checkpoint_ready(seeds.sparkSession)
    reached = start
    frontier = start
    for depth in range(1, hops + 1):
        step = (
            frontier.join(links, "name")
            .select("query_id", F.col("neighbour").alias("name"))
            .distinct()
            .join(reached.select("query_id", "name"), ["query_id", "name"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if max_nodes is not None:
            w = Window.partitionBy("query_id").orderBy("name")
            step = step.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_nodes).drop("_rn")
        # Each hop is used by the next one and by the result; cutting the lineage
        # keeps the plan from doubling per hop.
        frontier = step.checkpoint()
        reached = reached.unionByName(frontier)
    if max_nodes is None:
        return reached
    w = Window.partitionBy("query_id").orderBy("depth", "name")
    return reached.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_nodes).drop("_rn")


#: Queries whose visits to a vertex share one number.
WORD_BITS = 64


def _bit_of() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each vertex and group of queries, with a bit for each query."""
    return rows.groupBy("_group", *keys).agg(F.bit_or(_bit_of()).alias("_mask"))


def _unpacked(rows: DataFrame) -> DataFrame:
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda i: F.getbit("_mask", i) == 1)
    return rows.withColumn("_bit", F.explode(bits)).drop("_mask")


def multi_hop_packed(seeds: DataFrame, relations: DataFrame, vertices: DataFrame | None = None, hops: int = MAX_HOPS,
              max_nodes: int | None = MAX_NODES) -> DataFrame:
    """The result of ``multi_hop``, for many queries.

    All queries walk together. Sixty-four of them are the bits of one number, for the vertices
    they have just reached and for those they have visited, so a hop joins each vertex
    with its links once for all of them, and what is new are the bits not visited yet.
    """
    start = seeds.select("query_id", "name").distinct()
    if vertices is not None:
        start = start.join(vertices.select("name"), "name", "left_semi").select("query_id", "name")
    number = F.row_number().over(Window.orderBy("query_id")) - 1
    queries = start.select("query_id").distinct().withColumn("_n", number).select(
        "query_id", F.floor(F.col("_n") / WORD_BITS).alias("_group"), (F.col("_n") % WORD_BITS).cast("int").alias("_bit")
    )
    links = both_directions(relations).select("name", "neighbour").distinct()
    if max_nodes is not None:
        # A vertex contributes at most max_nodes + visited names to any query; the
        # visited ones number at most max_nodes, so twice the limit is enough.
        w = Window.partitionBy("name").orderBy("neighbour")
        links = links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2 * max_nodes).drop("_rn")
    # Ranked once, read by each hop.
    links = materialize(links, "links")
    hop = start.join(queries, "query_id").select("_group", "name", "_bit")
    reached = hop.withColumn("depth", F.lit(0))
    none = F.lit(0).cast("long")
    for depth in range(1, hops + 1):
        arriving = _packed(hop, "name").join(links, "name").select("_group", F.col("neighbour").alias("name"), F.col("_mask").alias("_to"), none.alias("_seen"))
        visited = reached.select("_group", "name", none.alias("_to"), _bit_of().alias("_seen"))
        met = arriving.unionByName(visited).groupBy("_group", "name").agg(F.bit_or("_to").alias("_to"), F.bit_or("_seen").alias("_seen"))
        new = met.select("_group", "name", F.col("_to").bitwiseAND(F.bitwise_not("_seen")).alias("_mask"))
        step = _unpacked(new.filter("_mask <> 0"))
        if max_nodes is not None:
            w = Window.partitionBy("_group", "_bit").orderBy("name")
            step = step.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_nodes).drop("_rn")
        hop = materialize(step, f"hop{depth}")
        reached = reached.unionByName(hop.withColumn("depth", F.lit(depth)))
    if max_nodes is not None:
        w = Window.partitionBy("_group", "_bit").orderBy("depth", "name")
        reached = reached.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_nodes).drop("_rn")
    return reached.join(queries, ["_group", "_bit"]).select("query_id", "name", "depth")


def facts(seeds: DataFrame, relations: DataFrame, max_facts: int = MAX_FACTS) -> DataFrame:
    """query_id, context: distinct ``A --[r]--> B`` lines around the seeds. Lines
    are deduplicated and cut to the limit before they are gathered."""
    lines = (
        seeds.select("query_id", "name").distinct()
        .join(both_directions(relations).distinct(), "name")
        .select(
            "query_id",
            F.concat("name", F.lit(" --["), "relation_type", F.lit("]--> "), "neighbour").alias("fact"),
        )
        .distinct()
    )
    w = Window.partitionBy("query_id").orderBy("fact")
    head = lines.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_facts)
    return head.groupBy("query_id").agg(
        F.concat(
            F.lit(lx.GRAPH_FACTS_HEADER), F.array_join(F.array_sort(F.collect_list("fact")), "\n")
        ).alias("context")
    )


def query_entities(queries: DataFrame, vertices: DataFrame, first: int = 5) -> DataFrame:
    """query_id, name: known entities among the first keywords of each query."""
    words = F.slice(F.regexp_extract_all("query", F.lit(tx.KEYWORD), F.lit(0)), 1, first)
    asked = queries.select("query_id", F.explode(words).alias("name")).distinct()
    return asked.join(vertices.select("name"), "name", "left_semi").select("query_id", "name")


# --- serialisation ----------------------------------------------------------------------------
def to_json_lines(vertices: DataFrame, relations: DataFrame) -> DataFrame:
    """The graph as JSON documents, one per vertex and per relation."""
    v = vertices.select(F.lit("entity").alias("kind"), F.to_json(F.struct(*vertices.columns)).alias("json"))
    r = relations.select(F.lit("relation").alias("kind"), F.to_json(F.struct(*relations.columns)).alias("json"))
    return v.unionByName(r)


def from_json_lines(lines: DataFrame, vertex_schema: str, relation_schema: str) -> tuple[DataFrame, DataFrame]:
    def read(kind: str, schema: str) -> DataFrame:
        parsed = lines.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("o"))
        return parsed.filter("o IS NOT NULL").select("o.*")

    return read("entity", vertex_schema), read("relation", relation_schema)
