"""The engine's operators on the relational tables: a query in the language, and SQL that must give the same rows.

Sequences are made from keys by md5, alike in Spark and SQL: 32 symbols that use the whole nucleotide alphabet.  Orders with status P have no sequence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import store_queries as stores
from helixframe.catalog.database import Database
from helixframe.functions.alphabets import AMINO_ACID, NUCLEOTIDE, Alphabet
from helixframe.functions.lineages import LineageTree
from helixframe.functions.trees import Tree
from helixframe.plans.relation import Relation
from helixframe.sources.store import numbered

_KINDS = {"string": "STRING", "int": "INT32", "bigint": "INT64", "double": "FLOAT", "date": "DATE32", "boolean": "BOOL"}
_HEX = "0123456789abcdef"
#: What the md5 digits become, in sequences and in the reference; and the same for genes.
NUCLEOTIDES, NUCLEOTIDES_OF_REFERENCE = "-ACGTRYSWKMBDHVN", "-ACGTACGTACGTACGT"
GENES = "ACDEFGHIKLMN*XB-"
REFERENCE = "ATGTACTCACAAGAAGTTCAATGG-GCCCTAA"
GENE_REFERENCE = "ACDEFGHIKLMN*XB-ACDEFGHIKLMN*XB-"
PROFILE = "ATGTACTCACRAGAAGTTCANTGG-GCCCTAA"
GENE_PROFILE = "ACDEFGHIKLMN*XB-ACXXFGHIKLMN*XB-"
#: An order with a sequence.
SAMPLE = 7
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: Nations that come from two regions: their own and the next one.
RECOMBINANTS = ("NATION_3", "NATION_12")

ORDERS = f"""(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS o_day,
    CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN true WHEN '5-LOW' THEN NULL ELSE false END AS o_urgent,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 10000) AS INT) END AS o_units,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_note,
    CASE WHEN o_orderstatus <> 'P' THEN translate(md5(CAST(o_orderkey AS VARCHAR(20))), '{_HEX}', '{NUCLEOTIDES}') END AS seq,
    CASE WHEN o_orderstatus <> 'O' THEN translate(md5(concat('g', CAST(o_orderkey AS VARCHAR(20)))), '{_HEX}', '{GENES}') END AS gene
    FROM orders)"""
#: Reads: one for each line, with an insertion at its number and one before, which may be the same; and what its gene has inserted.
_READ = "l_orderkey * 8 + l_linenumber"
_INS = f"substring(translate(md5(CAST(l_{{}} AS VARCHAR(20))), '{_HEX}', '{{}}'), 1, {{}})"
INSERTED = (
    f"SELECT {_READ} AS read_id, l_linenumber AS pos, {_INS.format('partkey', NUCLEOTIDES, 3)} AS ins FROM lineitem "
    f"UNION ALL SELECT {_READ}, l_linenumber - 1, {_INS.format('partkey', NUCLEOTIDES, 3)} FROM lineitem WHERE l_partkey % 2 = 1"
)
GENES_INSERTED = f"SELECT {_READ} AS read_id, l_linenumber AS pos, {_INS.format('suppkey', GENES, 2)} AS ins FROM lineitem"
READS = f"""SELECT {_READ} AS read_id, array(struct(l_linenumber AS pos, {_INS.format('partkey', NUCLEOTIDES, 3)} AS ins),
    struct(CAST(l_linenumber - l_partkey % 2 AS INT) AS pos, {_INS.format('partkey', NUCLEOTIDES, 3)} AS ins)) AS reading__ins,
    array(struct(l_linenumber AS pos, {_INS.format('suppkey', GENES, 2)} AS ins)) AS product__ins FROM {{l}}"""
#: Whole genomes: the sequences of orders, so often.
TIMES = 125
#: Customers at a place that may be null or not in the tree.
VISITORS = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN concat('PORT_', CAST(c_custkey % 7 AS VARCHAR(20))) ELSE concat('NATION_', CAST(c_nationkey AS VARCHAR(20))) END AS v_place, c_nationkey FROM customer)"


def _nations() -> dict[str, int]:
    return {f"NATION_{k}": k % 5 for k in range(25)}


def lineage_text() -> str:
    """World, regions and nations; two nations are recombinants; 'OLD WORLD' is an alias."""
    out = ["WORLD:", "  aliases: [OLD WORLD]", *[f"{r}:\n  parents: [WORLD]" for r in _REGIONS]]
    for n, r in _nations().items():
        parents = [_REGIONS[r], _REGIONS[(r + 1) % 5]] if n in RECOMBINANTS else [_REGIONS[r]]
        out.append(f"{n}:\n  parents: [{', '.join(parents)}]")
    return "\n".join(out)


def newick_text(lengths: bool = False) -> str:
    """Nations in regions; with lengths a nation's branch is as long as its number, and a region's 0.5."""
    leaf = lambda n: f"{n}:{n.removeprefix('NATION_')}" if lengths else n
    groups = [",".join(leaf(n) for n, k in _nations().items() if k == r) for r in range(5)]
    return "(" + ",".join(f"({g}){name.replace(' ', '_')}{':0.5' if lengths else ''}" for g, name in zip(groups, _REGIONS, strict=True)) + ")WORLD;"


def _register(db: Database, name: str, df: DataFrame, key: str, kinds: dict[str, str] | None = None, **more) -> None:
    own = {c: _KINDS[t] for c, t in df.dtypes if not c.endswith("__ins")}
    db.register(name, df, own | (kinds or {}), key, **more)


TABLES = ("region", "nation", "supplier", "part", "customer", "lineitem", "events", "orders", "reads", "genomes", "visitors")
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "part": "p_partkey"}


def database(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> Database:
    """The relational tables named; nothing is read until a query runs."""
    db = Database(spark=spark)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    for name in names:
        if name in _KEYS:
            _register(db, name, read(name), _KEYS[name])
        elif name == "customer":
            nation = read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("c_nation"))
            customer = read(name).join(F.broadcast(nation), F.col("c_nationkey") == F.col("k")).drop("k")  # 25 nations
            kinds = {"c_nation": "DICTIONARY_ENCODED", "c_mktsegment": "DICTIONARY_ENCODED"}
            _register(db, name, customer.withColumn("c_place", F.col("c_nation")), "c_name", kinds, lineages={"c_nation": LineageTree.from_yaml(lineage_text())}, trees={"c_place": Tree.from_newick(newick_text())})
        elif name == "lineitem":
            _register(db, name, read(name).withColumn("l_shipdate", F.col("l_shipdate").cast("date")), "l_orderkey")
        elif name == "events":
            _register(db, name, read(name).withColumn("day", F.to_date("ts")).drop("ts"), "event_id")
        elif name == "orders":
            orders = spark.sql(ORDERS.replace("FROM orders", "FROM {o}")[1:-1], o=read(name))
            _register(db, name, orders, "o_orderkey", {"seq": "NUCLEOTIDE_SEQUENCE", "gene": "AMINO_ACID_SEQUENCE"}, references={"seq": REFERENCE, "gene": GENE_REFERENCE})
        elif name == "reads":
            reads = spark.sql(READS, l=read("lineitem")).withColumns({"reading": F.lit(REFERENCE), "product": F.lit(GENE_REFERENCE)})
            kinds = {"reading": "NUCLEOTIDE_SEQUENCE", "product": "AMINO_ACID_SEQUENCE"}
            _register(db, name, reads, "read_id", kinds, references={"reading": REFERENCE, "product": GENE_REFERENCE})
        elif name == "genomes":
            orders = spark.sql(ORDERS.replace("FROM orders", "FROM {o}")[1:-1], o=read("orders"))
            genomes = orders.select("o_orderkey", "o_urgent", F.repeat("seq", TIMES).alias("genome"))
            _register(db, name, genomes, "o_orderkey", {"genome": "NUCLEOTIDE_SEQUENCE"}, references={"genome": REFERENCE * TIMES})
        elif name == "visitors":
            visitors = spark.sql(VISITORS.replace("FROM customer", "FROM {c}")[1:-1], c=read("customer")).withColumn("v_way", F.col("v_place"))
            _register(db, name, visitors, "c_custkey", trees={"v_place": Tree.from_newick(newick_text()), "v_way": Tree.from_newick(newick_text(True))})
    return db


def relation(spark: SparkSession, sf_dir: str, text: str) -> Relation:
    return database(spark, sf_dir, [t for t in TABLES if re.search(rf"\b{t}\b", text)]).relation(text)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return relation(spark, sf_dir, text).result()


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def _letters(position: int) -> str:
    return f"substring(seq, {position}, 1)"


def _not_ambiguous(reference: str, position: int) -> str:
    """What differs for sure from the reference."""
    return _list(set(NUCLEOTIDE.symbols) - NUCLEOTIDE.may_be[reference[position - 1]])


def _may(symbol: str) -> str:
    return _list(NUCLEOTIDE.may_be[symbol])


def _mutation_sql(column: str, reference: str, valid: str, proportion: float, where: str = "true") -> str:
    return f"""
        WITH s AS (SELECT unnest(range(1, 33)) AS position, {column} AS t FROM {ORDERS} WHERE {column} IS NOT NULL AND ({where})),
             c AS (SELECT position, substring(t, position, 1) AS sym, count(*) AS n FROM s GROUP BY ALL),
             v AS (SELECT *, sum(n) OVER (PARTITION BY position) AS cov FROM c WHERE strpos('{valid}', sym) > 0)
        SELECT substring('{reference}', position, 1) AS "mutationFrom", sym AS "mutationTo", '{column}' AS "sequenceName", CAST(position AS INT) AS position,
               CAST(n AS DOUBLE) / CAST(cov AS DOUBLE) AS proportion, CAST(cov AS INT) AS coverage, CAST(n AS INT) AS count
        FROM v WHERE sym <> substring('{reference}', position, 1) AND n >= greatest(1, ceil(CAST(cov AS DOUBLE) * CAST({proportion} AS DOUBLE)))"""


def _distance_sql(profile: str, column: str = "seq", alphabet: Alphabet = NUCLEOTIDE) -> str:
    terms = [f"CASE WHEN substring({column}, {k + 1}, 1) NOT IN {_list(alphabet.may_be[s])} THEN 1 ELSE 0 END" for k, s in enumerate(profile) if s != alphabet.missing]
    return " + ".join(terms)


def _profile_sql(distance: int, profile: str = PROFILE, column: str = "seq", alphabet: Alphabet = NUCLEOTIDE) -> str:
    return f"{column} IS NULL OR ({_distance_sql(profile, column, alphabet)}) <= {distance}"


def _far_sql(column: str, other: str) -> str:
    """The distance of two sequences, where the other one is known to SQL alone."""
    fits = " OR ".join(f"(substring({other}, {{k}}, 1) = '{t}' AND substring({column}, {{k}}, 1) IN {_list(NUCLEOTIDE.may_be[t])})" for t in NUCLEOTIDE.symbols if t != "N")
    return " + ".join(f"CASE WHEN substring({other}, {k}, 1) = 'N' OR {fits.format(k=k)} THEN 0 ELSE 1 END" for k in range(1, 33))


def _count(where: str, table: str = ORDERS) -> str:
    return f"SELECT count(*) AS n FROM {table} WHERE {where}"


def _shuffled_sql(rows: str, seed: int) -> str:
    """Rows with k, and x, by which randomize sorts them: a finaliser of 64 bits (fixed constants), unsigned."""
    x = f"xor(CAST(k AS UBIGINT), CAST({seed} AS UBIGINT))"
    for level, factor in enumerate(("18397679294719823053", "14181476777654086739")):
        rows = f"SELECT * REPLACE (CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * CAST('{factor}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT) AS x) FROM ({f'SELECT *, {x} AS x FROM ({rows})' if not level else rows})"
    return f"SELECT * REPLACE (xor(x, x >> 33) AS x) FROM ({rows})"


_CUSTOMER = "(SELECT c.*, n.n_name AS c_nation, n.n_name AS c_place, n.n_regionkey AS regionkey FROM customer c JOIN nation n ON c_nationkey = n_nationkey)"
_N = "groupBy({n:=count()})"
_BRANCH = f"SELECT regionkey, string_agg(DISTINCT c_place, ',' ORDER BY c_place) AS names, count(DISTINCT c_place) AS k FROM {_CUSTOMER}"

#: name -> (query, SQL)
LANGUAGE: dict[str, tuple[str, str]] = {
    "flagship_top_nations": (
        "customer.filter(c_mktsegment = 'BUILDING').groupBy({count:=count()}, {c_nationkey}).orderBy({count.desc(), c_nationkey}).limit(5)",
        "SELECT c_nationkey, count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey ORDER BY count DESC, c_nationkey LIMIT 5",
    ),
    # pipeline operators
    "p1_filter_and_or_not": (f"orders.filter(o_orderstatus = 'F' && !(o_units > 20 || o_urgent = true)).{_N}", _count("o_orderstatus = 'F' AND (o_units > 20 OR o_urgent = true) IS NOT TRUE")),
    "p2_project": ("supplier.project({s_name, s_acctbal})", "SELECT s_name, s_acctbal FROM supplier"),
    "p3_map": (
        "nation.map({n_name := n_regionkey, tag := 'x', one := 1, half := 0.5, yes := true, letter := n_name.at(8)})",
        "SELECT n_nationkey, n_regionkey AS n_name, n_regionkey, 'x' AS tag, CAST(1 AS BIGINT) AS one, CAST(0.5 AS DOUBLE) AS half, true AS yes, substring(n_name, 8, 1) AS letter FROM nation",
    ),
    "p4_group_by": ("orders.groupBy({n:=count()}, {o_orderpriority, o_urgent})", f"SELECT o_orderpriority, o_urgent, count(*) AS n FROM {ORDERS} GROUP BY 1, 2"),
    "p4_group_by_null_key": ("orders.groupBy({n:=count()}, {o_note})", f"SELECT o_note, count(*) AS n FROM {ORDERS} GROUP BY 1"),
    "p4_count_of_nothing": (f"orders.filter(false).{_N}", "SELECT CAST(0 AS BIGINT) AS n"),
    "p6_p7_limit_offset": ("customer.project({c_custkey, c_acctbal}).orderBy({c_acctbal.desc(), c_custkey}).offset(10).limit(20)", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10"),
    "p9_join_inner": ("nation.join(region, n_regionkey = r_regionkey)", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "p9_join_left": ("customer.project({c_custkey}).join(orders.filter(o_urgent = true).project({o_orderkey, o_custkey}), c_custkey = o_custkey, type:=left)", f"SELECT c_custkey, o_orderkey, o_custkey FROM customer LEFT JOIN (SELECT * FROM {ORDERS} WHERE o_urgent) ON c_custkey = o_custkey"),
    "p9_join_right": ("nation.filter(n_nationkey < 7).join(supplier, n_nationkey = s_nationkey, type:=right).project({n_name, s_suppkey})", "SELECT n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 7) RIGHT JOIN supplier ON n_nationkey = s_nationkey"),
    "p9_join_full": ("nation.filter(n_nationkey < 7).join(region.filter(r_regionkey > 2), n_regionkey = r_regionkey, type:=full).project({n_name, r_name})", "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 7) FULL JOIN (SELECT * FROM region WHERE r_regionkey > 2) ON n_regionkey = r_regionkey"),
    "p9_join_left_semi": ("customer.project({c_custkey, c_name}).join(orders.filter(o_totalprice > 450000.0), c_custkey = o_custkey, type:=leftSemi)", f"SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM {ORDERS} WHERE o_totalprice > 450000) ON c_custkey = o_custkey"),
    "p9_join_right_semi": ("orders.filter(o_totalprice > 450000.0).project({o_custkey}).join(customer.project({c_custkey, c_name}), o_custkey = c_custkey, type:=rightSemi)", f"SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM {ORDERS} WHERE o_totalprice > 450000) ON c_custkey = o_custkey"),
    "p9_join_left_anti": ("customer.project({c_custkey}).join(orders.filter(o_totalprice > 300000.0), c_custkey = o_custkey, type:=leftAnti)", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey"),
    "p9_join_right_anti": ("orders.filter(o_totalprice > 300000.0).project({o_custkey}).join(customer.project({c_custkey}), c_custkey = o_custkey, type:=rightAnti)", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey"),
    "p9_join_two_keys": (
        "lineitem.project({l_suppkey, l_partkey, l_orderkey}).join(supplier.map({k := s_suppkey, r := s_suppkey}).project({k, r, s_name}), l_suppkey = k && r = l_suppkey).groupBy({n:=count()}, {s_name})",
        "SELECT s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    ),
    "p10_union_all": ("orders.filter(o_orderstatus = 'F').project({o_orderkey}).unionAll(orders.filter(o_urgent = true).project({o_orderkey}))", f"SELECT o_orderkey FROM {ORDERS} WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM {ORDERS} WHERE o_urgent"),
    "p11_schema": ("nation.schema()", "SELECT * FROM (VALUES ('n_name', 'STRING'), ('n_nationkey', 'INT32'), ('n_regionkey', 'INT32')) AS t(\"fieldName\", type)"),
    "p12_mutations": ("orders.mutations(minProportion:=0.05)", _mutation_sql("seq", REFERENCE, "-ACGT", 0.05)),
    "p12_mutations_filtered": ("orders.filter(o_urgent = true).mutations(minProportion:=0.2, sequenceNames:={seq}, fields:={count, position, mutationTo})", f"SELECT \"mutationTo\", position, count FROM ({_mutation_sql('seq', REFERENCE, '-ACGT', 0.2, 'o_urgent')})"),
    "p12_mutations_all_but_one": ("orders.filter(!(o_orderkey = 3)).mutations(minProportion:=0.0)", _mutation_sql("seq", REFERENCE, "-ACGT", 0.0, "o_orderkey <> 3")),
    "p13_amino_acid_mutations": ("orders.aminoAcidMutations(minProportion:=0.07)", _mutation_sql("gene", GENE_REFERENCE, "-ACDEFGHIKLMNOPQRSTUVWY*", 0.07)),
    "p14_insertions": ("reads.insertions()", f"SELECT CAST(pos AS INT) AS position, ins AS \"insertedSymbols\", 'reading' AS \"sequenceName\", CAST(count(*) AS INT) AS count FROM ({INSERTED}) GROUP BY 1, 2"),
    "p15_amino_acid_insertions": ("reads.aminoAcidInsertions(sequenceNames:={product})", f"SELECT pos AS position, ins AS \"insertedSymbols\", 'product' AS \"sequenceName\", CAST(count(*) AS INT) AS count FROM ({GENES_INSERTED}) GROUP BY 1, 2"),
    "p12_mutations_of_genomes": ("genomes.mutations(minProportion:=0.05)", f"SELECT \"mutationFrom\", \"mutationTo\", 'genome' AS \"sequenceName\", CAST(position + 32 * r AS INT) AS position, proportion, coverage, count FROM ({_mutation_sql('seq', REFERENCE, '-ACGT', 0.05)}), unnest(range({TIMES})) t(r)"),
    "p16_missing_labels": (
        "visitors.filter(c_nationkey = 6 || c_nationkey = 11).mostRecentCommonAncestor('v_place', printNodesNotInTree:=true)",
        f"""SELECT CAST(count(*) FILTER (v_place IS NULL) + count(DISTINCT v_place) FILTER (starts_with(v_place, 'PORT')) AS INT) AS "missingNodeCount",
            coalesce(string_agg(DISTINCT v_place, ',' ORDER BY v_place) FILTER (starts_with(v_place, 'PORT')), '') AS "missingFromTree",
            CASE count(DISTINCT v_place) FILTER (starts_with(v_place, 'NATION')) WHEN 0 THEN NULL WHEN 1 THEN min(v_place) FILTER (starts_with(v_place, 'NATION')) ELSE 'AMERICA' END AS "mrcaNode",
            CASE count(DISTINCT v_place) FILTER (starts_with(v_place, 'NATION')) WHEN 0 THEN NULL WHEN 1 THEN 'AMERICA' ELSE 'WORLD' END AS "mrcaParent",
            CAST(CASE count(DISTINCT v_place) FILTER (starts_with(v_place, 'NATION')) WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 1 END AS INT) AS "mrcaDepth" FROM {VISITORS} WHERE c_nationkey IN (6, 11)""",
    ),
    "p16_only_missing_labels": (
        "visitors.filter(v_place.isNull() || v_place.like('^PORT')).mostRecentCommonAncestor('v_place')",
        f"""SELECT CAST(count(*) FILTER (v_place IS NULL) + count(DISTINCT v_place) AS INT) AS "missingNodeCount", CAST(NULL AS VARCHAR) AS "mrcaNode", CAST(NULL AS VARCHAR) AS "mrcaParent", CAST(NULL AS INT) AS "mrcaDepth"
            FROM {VISITORS} WHERE v_place IS NULL OR starts_with(v_place, 'PORT')""",
    ),
    "p16_common_ancestor": (
        "customer.filter(c_acctbal > 9990.0).mostRecentCommonAncestor('c_place')",
        f"""SELECT CAST(0 AS INT) AS "missingNodeCount", CASE WHEN k = 1 THEN place WHEN r = 1 THEN region WHEN k > 0 THEN 'WORLD' END AS "mrcaNode",
            CASE WHEN k = 1 THEN region WHEN r = 1 THEN 'WORLD' END AS "mrcaParent", CAST(CASE WHEN k = 1 THEN 2 WHEN r = 1 THEN 1 WHEN k > 0 THEN 0 END AS INT) AS "mrcaDepth"
            FROM (SELECT count(DISTINCT c_place) AS k, count(DISTINCT regionkey) AS r, min(c_place) AS place, min(replace(r_name, ' ', '_')) AS region
                  FROM {_CUSTOMER} JOIN region ON regionkey = r_regionkey WHERE c_acctbal > 9990)""",
    ),
    "p16_common_ancestor_of_a_region": ("customer.filter(c_nation = 'NATION_6' || c_nation = 'NATION_11').mostRecentCommonAncestor('c_place', printNodesNotInTree:=true)", "SELECT CAST(0 AS INT) AS \"missingNodeCount\", '' AS \"missingFromTree\", 'AMERICA' AS \"mrcaNode\", 'WORLD' AS \"mrcaParent\", CAST(1 AS INT) AS \"mrcaDepth\""),
    "p17_subtree": (
        "customer.filter(c_nation = 'NATION_6' || c_nation = 'NATION_1' || c_nation = 'NATION_2').phyloSubtree('c_place')",
        f"""SELECT CAST(0 AS INT) AS "missingNodeCount", '(' || string_agg(CASE WHEN k > 1 THEN '(' || names || ')' || replace(r_name, ' ', '_') ELSE names END, ',' ORDER BY regionkey) || ')WORLD;' AS "subtreeNewick"
            FROM ({_BRANCH} WHERE c_nation IN ('NATION_6', 'NATION_1', 'NATION_2') GROUP BY 1) JOIN region ON regionkey = r_regionkey""",
    ),
    "p17_missing_labels": (
        "visitors.filter(c_nationkey = 6 || c_nationkey = 1 || c_nationkey = 2).phyloSubtree('v_place', printNodesNotInTree:=true, contractUnaryNodes:=false)",
        f"""WITH v AS (SELECT * FROM {VISITORS} WHERE c_nationkey IN (6, 1, 2)),
            g AS (SELECT c_nationkey % 5 AS r, '(' || string_agg(DISTINCT v_place, ',' ORDER BY v_place) || ')' || CASE c_nationkey % 5 WHEN 1 THEN 'AMERICA' ELSE 'ASIA' END AS t FROM v WHERE starts_with(v_place, 'NATION') GROUP BY 1)
            SELECT CAST(count(*) FILTER (v_place IS NULL) + count(DISTINCT v_place) FILTER (starts_with(v_place, 'PORT')) AS INT) AS "missingNodeCount",
            coalesce(string_agg(DISTINCT v_place, ',' ORDER BY v_place) FILTER (starts_with(v_place, 'PORT')), '') AS "missingFromTree", (SELECT '(' || string_agg(t, ',' ORDER BY r) || ')WORLD;' FROM g) AS "subtreeNewick" FROM v""",
    ),
    "p17_branch_lengths": (
        "visitors.filter(c_nationkey = 6 || c_nationkey = 1 || c_nationkey = 2 || c_nationkey = 3).phyloSubtree('v_way')",
        f"""WITH v AS (SELECT * FROM {VISITORS} WHERE c_nationkey IN (6, 1, 2, 3)),
            n AS (SELECT DISTINCT c_nationkey AS k, c_nationkey % 5 AS r FROM v WHERE starts_with(v_place, 'NATION')),
            g AS (SELECT r, CASE WHEN count(*) = 1 THEN 'NATION_' || min(k) || ':' || (min(k) + 0.5) ELSE '(' || string_agg('NATION_' || k || ':' || k, ',' ORDER BY k) || ')AMERICA:0.5' END AS t FROM n GROUP BY r)
            SELECT CAST(count(*) FILTER (v_place IS NULL) + count(DISTINCT v_place) FILTER (starts_with(v_place, 'PORT')) AS INT) AS "missingNodeCount",
            (SELECT '(' || string_agg(t, ',' ORDER BY r) || ')WORLD;' FROM g) AS "subtreeNewick" FROM v""",
    ),
    "l7_quoted_names": ("nation.map({\"a \"\"name\"\"\" := n_name}).filter(\"a \"\"name\"\"\" = 'NATION_3').project({n_nationkey, \"n_name\"})", "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_3'"),
    "l8_comments": ("nation -- the whole table\n  .filter(n_regionkey = 2) -- of ASIA, 'quoted' or not\n  .project({n_name})", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    # predicates
    "l2_not_equal_keeps_nulls": (f"orders.filter(o_units <> 5).{_N}", _count("(o_units = 5) IS NOT TRUE")),
    "l2_equals_null": (f"orders.filter(o_note = null).{_N}", _count("o_note IS NULL")),
    "l3_ordering": (f"orders.filter(o_units >= 10 && 30 > o_units && o_totalprice < 250000.5 && o_day > '1997-03-01'::date && o_note <= '3').{_N}", _count("o_units >= 10 AND o_units < 30 AND o_totalprice < 250000.5 AND o_day > DATE '1997-03-01' AND o_note <= '3'")),
    "l3_negated_ordering": (f"orders.filter(!(o_units >= 10)).{_N}", _count("(o_units >= 10) IS NOT TRUE")),
    "f1_between_int": (f"orders.filter(o_units.between(3, 12)).{_N}", _count("o_units BETWEEN 3 AND 12")),
    "f1_between_float_open": (f"orders.filter(o_totalprice.between(null, 112946.26)).{_N}", _count("o_totalprice < 112946.26")),
    "f1_between_date": (f"orders.filter(!o_day.between('1996-01-01'::date, '1997-12-31'::date)).{_N}", _count("NOT (o_day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')")),
    "f2_in": (f"orders.filter(o_note.in({{'1-URGENT', '3-MEDIUM', 'none'}})).{_N}", _count("o_note IN ('1-URGENT', '3-MEDIUM', 'none')")),
    "f2_not_in": (f"orders.filter(!o_note.in({{'1-URGENT'}})).{_N}", _count("(o_note IN ('1-URGENT')) IS NOT TRUE")),
    "f3_f4_null_tests": (f"orders.filter(seq.isNull() && gene.isNotNull()).{_N}", _count("seq IS NULL AND gene IS NOT NULL")),
    "f5_like": (f"part.filter(p_name.like('^(red|small) .*t$')).{_N}", _count("regexp_matches(p_name, '^(red|small) .*t$')", "part")),
    "f5_not_like": (f"orders.filter(!o_note.like('URG')).{_N}", _count("(regexp_matches(o_note, 'URG')) IS NOT TRUE")),
    "f6_lineage_exact": (f"customer.filter(c_nation.lineage('NATION_7')).{_N}", _count("c_nation = 'NATION_7'", _CUSTOMER)),
    "f6_lineage_sublineages": ("customer.filter(c_nation.lineage('EUROPE', includeSublineages:=true)).groupBy({n:=count()}, {c_nation})", f"SELECT c_nation, count(*) AS n FROM {_CUSTOMER} WHERE regionkey = 3 AND c_nation NOT IN {_list(RECOMBINANTS)} GROUP BY 1"),
    "f6_lineage_always_follow": ("customer.filter(c_nation.lineage('EUROPE', recombinantFollowingMode:='alwaysFollow')).groupBy({n:=count()}, {c_nation})", f"SELECT c_nation, count(*) AS n FROM {_CUSTOMER} WHERE regionkey = 3 OR c_nation = 'NATION_12' GROUP BY 1"),
    "f6_lineage_contained_alias": (f"customer.filter(c_nation.lineage('OLD WORLD', recombinantFollowingMode:='followIfFullyContainedInClade')).{_N}", _count("true", _CUSTOMER)),
    "f7_descendant_of": ("customer.filter(c_place.phyloDescendantOf('ASIA')).groupBy({n:=count()}, {c_place})", f"SELECT c_place, count(*) AS n FROM {_CUSTOMER} WHERE regionkey = 2 GROUP BY 1"),
    "f8_nucleotide_equals": (f"orders.filter(nucleotideEquals(position:=5, symbol:='C', sequenceName:='seq') || nucleotideEquals(position:=5, symbol:='.', sequenceName:='seq')).{_N}", _count(f"{_letters(5)} IN ('C', 'A')")),
    "f8_not_equals_keeps_nulls": (f"orders.filter(!nucleotideEquals(position:=5, symbol:='N', sequenceName:='seq')).{_N}", _count(f"({_letters(5)} = 'N') IS NOT TRUE")),
    "f9_amino_acid_equals": (f"orders.filter(aminoAcidEquals(position:=13, symbol:='*', sequenceName:='gene')).{_N}", _count("substring(gene, 13, 1) = '*'")),
    "f10_has_mutation": (f"orders.filter(hasMutation(position:=2, sequenceName:='seq')).{_N}", _count(f"{_letters(2)} IN {_not_ambiguous(REFERENCE, 2)}")),
    "f11_has_aa_mutation": (f"orders.filter(hasAAMutation(position:=15, sequenceName:='gene')).{_N}", _count("substring(gene, 15, 1) NOT IN ('B', 'X')")),
    "f12_insertion_contains": ("reads.filter(insertionContains(position:=3, value:='A.*', sequenceName:='reading')).project({read_id})", f"SELECT read_id FROM ({INSERTED}) WHERE pos = 3 AND starts_with(ins, 'A')"),
    "f13_amino_acid_insertion_contains": ("reads.filter(!aminoAcidInsertionContains(position:=2, value:='.*\\*', sequenceName:='product')).project({read_id})", f"SELECT read_id FROM ({GENES_INSERTED}) WHERE NOT (pos = 2 AND ends_with(ins, '*'))"),
    "f14_maybe": (f"orders.filter(maybe(nucleotideEquals(position:=7, symbol:='T', sequenceName:='seq') && !nucleotideEquals(position:=8, symbol:='C', sequenceName:='seq'))).{_N}", _count(f"{_letters(7)} IN {_may('T')} AND {_letters(8)} <> 'C'")),
    "f15_exact_in_maybe": (f"orders.filter(maybe(exact(nucleotideEquals(position:=7, symbol:='T', sequenceName:='seq')) || hasMutation(position:=9, sequenceName:='seq'))).{_N}", _count(f"{_letters(7)} = 'T' OR {_letters(9)} <> 'A'")),
    "f16_n_of": (
        f"orders.filter(nOf(2, {{o_urgent = true, o_units > 20, nucleotideEquals(position:=1, symbol:='A', sequenceName:='seq'), o_orderstatus = 'F'}})).{_N}",
        _count(f"CAST(coalesce(o_urgent, false) AS INT) + CAST(coalesce(o_units > 20, false) AS INT) + CAST(coalesce({_letters(1)} = 'A', false) AS INT) + CAST(o_orderstatus = 'F' AS INT) >= 2"),
    ),
    "f16_n_of_exactly": (f"orders.filter(!nOf(1, {{o_urgent = true, o_units > 20, o_orderstatus = 'F'}}, matchExactly:=true)).{_N}", _count("CAST(coalesce(o_urgent, false) AS INT) + CAST(coalesce(o_units > 20, false) AS INT) + CAST(o_orderstatus = 'F' AS INT) <> 1")),
    **{f"f17_profile_{d}": (f"orders.filter(nucleotideMutationProfile(distance:={d}, sequenceName:='seq', querySequence:='{PROFILE}')).{_N}", _count(_profile_sql(d))) for d in (0, 15, 22)},
    "f17_profile_by_id": (f"orders.filter(nucleotideMutationProfile(distance:=17, sequenceName:='seq', sequenceId:='{SAMPLE}')).{_N}", _count(f"seq IS NULL OR ({_far_sql('seq', 'other')}) <= 17", f"(SELECT seq, (SELECT seq FROM {ORDERS} WHERE o_orderkey = {SAMPLE}) AS other FROM {ORDERS})")),
    "f17_profile_by_mutations": (
        f"orders.filter(nucleotideMutationProfile(distance:=16, sequenceName:='seq', mutations:={{{{position:=4, symbol:='A'}}, {{position:=30, symbol:='R'}}}})).{_N}",
        _count(_profile_sql(16, REFERENCE[:3] + "A" + REFERENCE[4:29] + "R" + REFERENCE[30:])),
    ),
    "f18_amino_acid_profile": (f"orders.filter(aminoAcidMutationProfile(distance:=24, sequenceName:='gene', querySequence:='{GENE_PROFILE}')).{_N}", _count(_profile_sql(24, GENE_PROFILE, "gene", AMINO_ACID))),
    "f18_amino_acid_profile_by_mutations": (
        f"orders.filter(!aminoAcidMutationProfile(distance:=26, sequenceName:='gene', mutations:={{{{position:=1, symbol:='K'}}}})).{_N}",
        _count(f"({_profile_sql(26, 'K' + GENE_REFERENCE[1:], 'gene', AMINO_ACID)}) IS NOT TRUE"),
    ),
    **{
        f"f17_genome_profile_{d}": (
            f"genomes.filter(nucleotideMutationProfile(distance:={d}, sequenceName:='genome', mutations:={{{{position:=3204, symbol:='G'}}}})).{_N}",
            # position 3204 is the fourth of a period, where the reference has T
            _count(f"seq IS NULL OR {TIMES} * ({_distance_sql(REFERENCE)}) - CASE WHEN {_letters(4)} NOT IN {_may('T')} THEN 1 ELSE 0 END + CASE WHEN {_letters(4)} NOT IN {_may('G')} THEN 1 ELSE 0 END <= {d}"),
        )
        for d in (0, 5, 50, 200, 2249, 2250)
    },
    "f8_genome_position": (f"genomes.filter(nucleotideEquals(position:=3204, symbol:='T', sequenceName:='genome') && hasMutation(position:=3970, sequenceName:='genome')).{_N}", _count(f"{_letters(4)} = 'T' AND {_letters(2)} IN {_not_ambiguous(REFERENCE, 2)}")),
    "f19_genome_co_occurrence": (
        "genomes.map({a := genome.at(1), b := genome.at(803), c := genome.at(1605), d := genome.at(2407), e := genome.at(3209), f := genome.at(3999)}).groupBy({n:=count()}, {a, b, c, d, e, f})",
        f"SELECT {_letters(1)} AS a, {_letters(3)} AS b, {_letters(5)} AS c, {_letters(7)} AS d, {_letters(9)} AS e, {_letters(31)} AS f, count(*) AS n FROM {ORDERS} GROUP BY 1, 2, 3, 4, 5, 6",
    ),
    "f19_co_occurrence": (
        "orders.map({a := seq.at(1), b := seq.at(2), c := seq.at(3)}).groupBy({n:=count()}, {a, b, c})",
        f"SELECT {_letters(1)} AS a, {_letters(2)} AS b, {_letters(3)} AS c, count(*) AS n FROM {ORDERS} GROUP BY 1, 2, 3",
    ),
    "f20_iso_week": ("orders.map({week := o_day.isoWeek()}).groupBy({n:=count()}, {week})", f"SELECT strftime(o_day, '%G-W%V') AS week, count(*) AS n FROM {ORDERS} GROUP BY 1"),
    "s1_scan": ("region", "SELECT r_name, r_regionkey FROM region"),
    "having_filter": ("orders.groupBy({n:=count()}, {o_custkey}).filter(n > 15)", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "many_equals": (f"customer.filter({' || '.join(f'c_name = {chr(39)}Customer#{k:09d}{chr(39)}' for k in range(0, 900, 9))}).{_N}", _count(f"c_name IN {_list(f'Customer#{k:09d}' for k in range(0, 900, 9))}", "customer")),
}


#: name -> (query, SQL): the order of the rows is the result, so each has its place.
ORDERED: dict[str, tuple[str, str]] = {
    "p5_order_by_nulls": ("orders.project({o_orderkey, o_units}).orderBy({o_units, o_orderkey.desc()})", f"SELECT o_orderkey, o_units, row_number() OVER (ORDER BY o_units ASC NULLS FIRST, o_orderkey DESC) - 1 AS place FROM {ORDERS}"),
    "p5_order_by_desc_nulls_last": ("orders.project({o_orderkey, o_units}).orderBy({o_units.desc(), o_orderkey})", f"SELECT o_orderkey, o_units, row_number() OVER (ORDER BY o_units DESC NULLS LAST, o_orderkey) - 1 AS place FROM {ORDERS}"),
    "p5_order_of_ties": ("orders.project({o_orderkey, o_note}).orderBy({o_orderkey.desc()}).orderBy({o_note})", f"SELECT o_orderkey, o_note, row_number() OVER (ORDER BY o_note ASC NULLS FIRST, o_orderkey DESC) - 1 AS place FROM {ORDERS}"),
    "p8_randomize": ("customer.project({c_custkey}).orderBy({c_custkey}).randomize(seed:=1231)", f"SELECT c_custkey, row_number() OVER (ORDER BY x, k) - 1 AS place FROM ({_shuffled_sql('SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer', 1231)})"),
    "p8_randomize_limit": ("orders.project({o_orderkey}).orderBy({o_orderkey.desc()}).randomize(seed:=7).limit(25)", f"SELECT o_orderkey, row_number() OVER (ORDER BY x, k) - 1 AS place FROM ({_shuffled_sql('SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS k FROM orders', 7)}) ORDER BY x, k LIMIT 25"),
}


def placed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return numbered(run(spark, sf_dir, text), [], "placed", "place")[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: partial(run, text=t) for n, (t, _) in LANGUAGE.items()} | {n: partial(placed, text=t) for n, (t, _) in ORDERED.items()} | stores.QUERIES


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in (LANGUAGE | ORDERED).items()} | stores.SQL
