"""Steps, cycles and counts that go through names: a hot name costs its references plus its definitions, not their product."""

from pyspark.sql import functions as F

from strataloom.operators import change, evaluation, graph, lookup, reach
from strataloom.plans.bind import resolved

SYMBOL = "id long, name string, kind string, file_path string, line_start int, line_end int, parent_id long, decorators string"
EDGE = "from_id long, to_name string, kind string, line int, target_kind string"
TARGETS = (None, "scoped", "function", "method", "macro")


def graph_of(spark, n=40, names=6):
    s = [(i, f"n{i % names}", ("method", "function", "class")[i % 3], f"p{i % 4}/f{i % 9}.py", i, i + 3, None, ",partial," if i % 2 else None) for i in range(n)]
    e = [(i, f"n{(i * k + k) % (names + 1)}", ("calls", "references", "imports")[(i + k) % 3], k, TARGETS[(i + k) % 5]) for i in range(0, n, 3) for k in range(1, 4)]
    return spark.createDataFrame(s, SYMBOL), spark.createDataFrame(e, EDGE)


def walks(steps, seeds, depth):
    """(seed, id): least length of a walk from id to another seed."""
    want = {}
    for seed in seeds:
        at = {seed}
        for k in range(1, depth + 1):
            at = {a for a, b in steps if b in at}
            for x in at - {seed}:
                want.setdefault((seed, x), k)
    return want


def test_others(spark):
    s, e = graph_of(spark)
    languages = s.withColumn("language", F.lit("py"))
    plain = {(r.from_id, r.to_id) for r in resolved(e.where("kind <> 'imports'"), languages).collect()}
    by = reach.steps_of(s, e, ("calls", "references"))
    assert {(r.from_id, r.to_id) for r in by.refs.join(by.defs, ["to_name", "means"]).collect()} == plain
    seeds = spark.range(0, 40, 5)
    want = walks(plain, range(0, 40, 5), 3)
    got = {r.id: r.depth for r in reach.others_of_all(by, seeds).collect()}
    assert got and got == {x: min(d for (_, y), d in want.items() if y == x) for _, x in want}
    part = {r.id: r.file_path.split("/")[0] for r in s.collect()}
    of_id = s.select("id", F.split("file_path", "/")[0].alias("part"))
    groups = {r.part: (r.impacted, r.nearest, r.seeds) for r in reach.other_groups(by, seeds, of_id, "part").collect()}
    assert groups == {p: (len({x for _, x in want if part[x] == p}), min(d for (_, x), d in want.items() if part[x] == p), len({y for y, x in want if part[x] == p})) for p in {part[x] for _, x in want}}
    crossed = {(r.from_component, r.to_component): r.symbols for r in change.crossings_of(by, s, seeds).collect()}
    pairs = {(part[y], part[x], x) for y, x in want if part[x] != part[y]}
    assert crossed == {(a, b): len({x for a2, b2, x in pairs if (a2, b2) == (a, b)}) for a, b, _ in pairs}


def test_a_hot_name_is_written_once_for_each_reference(spark, monkeypatch):
    s = spark.range(300).selectExpr("id", "'hot' as name", "'class' as kind", "concat('f', id) as file_path")
    e = spark.range(300).selectExpr("id as from_id", "'hot' as to_name", "'calls' as kind", "1 as line", "cast(null as string) as target_kind")
    rows, cut = [], reach.cut
    monkeypatch.setattr(reach, "cut", lambda df, name: rows.append((name, (t := cut(df, name)).count())) or t)
    assert reach.others_of_all(reach.steps_of(s, e, ("calls",)), s.select("id")).count() == 300
    assert max(n for _, n in rows) <= 600  # as pairs of symbols they were 90,000


def test_cycles_through_names(spark):
    s, e = graph_of(spark, 60, 11)
    pairs = graph.import_pairs(s, e)
    plain = lambda rows: sorted(map(tuple, rows.collect()))
    assert plain(graph.cycle_nodes(graph.imports_of(s, e))) == plain(graph.cycle_nodes(pairs)) != []
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    inside = pairs.where(folder("from_file") == folder("to_file"))
    assert plain(graph.cycle_nodes(graph.imports_of(s, e, inside_folders=True))) == plain(graph.cycle_nodes(inside))
    alone = s.where("id = 0"), e.where("false").unionByName(spark.createDataFrame([(0, "n0", "imports", 1, None)], EDGE))
    assert graph.cycle_nodes(graph.imports_of(*alone)).count() == 0


def test_cycles_of_many_pairs_have_no_cap(spark):
    """300 files that all import what all define make 89,700 pairs and one cycle."""
    s = spark.range(300).selectExpr("id", "'hot' as name", "'class' as kind", "concat('d/f', id) as file_path")
    e = spark.range(300).selectExpr("id as from_id", "'hot' as to_name", "'imports' as kind", "1 as line", "cast(null as string) as target_kind")
    (got,) = graph.cycles_answer(graph.imports_of(s, e, inside_folders=True), 20).collect()
    assert (got["size"], got.total, got.total_members, got.truncated) == (300, 1, 300, False)


def test_boundary_counts(spark):
    s, e = graph_of(spark)
    part = F.split("file_path", "/")[0]
    own = s.select(F.col("id").alias("from_id"), part.alias("a"))
    want = resolved(e, s.withColumn("language", F.lit("py"))).join(own, "from_id").withColumn("b", F.split("to_file", "/")[0]).where("a <> b").groupBy("a", "b").count()
    assert sorted(map(tuple, graph.boundary_counts(s, e, part).collect())) == sorted(map(tuple, want.collect())) != []


def test_search_without_caps(spark):
    s = spark.range(700).selectExpr("id", "'x' as name", "'class' as kind", "concat('d', id, '/f') as file_path", "1 as line_start", "',partial,' as decorators", "cast(null as long) as parent_id")
    got = lookup.search_grouped(s, "x", top=None, raw_limit=None).collect()
    assert len(got) == 700 and {(r.raw_candidate_total, r.raw_candidates_examined, r.total, r.returned, r.truncated, r.truncation_reason, r.locations) for r in got} == {(700, 700, 700, 700, False, None, 1)}
    assert lookup.search_grouped(s, "x", top=None, raw_limit=None, namespaces=lookup.enclosing_names(s)).count() == 700


def test_pairs_up_to(spark):
    s, e = graph_of(spark)
    n = graph.import_pairs(s, e).count()
    assert graph.pairs_up_to(graph.imports_of(s, e), n) == n > 0 and graph.pairs_up_to(graph.imports_of(s, e), n - 1) > n - 1
    assert graph.pairs_up_to(graph.imports_of(s, e.where("false")), 5) == 0


def test_reach_of_all_by_classes(spark, monkeypatch):
    s, e = graph_of(spark)
    steps = reach.steps_of(s, e, ("calls", "references"))
    plain = {(r.from_id, r.to_id) for r in resolved(e.where("kind <> 'imports'"), s.withColumn("language", F.lit("py"))).collect()}
    want = walks(plain, range(40), 3)
    found = reach.kin(steps, 3)
    assert {(r.seed, r.id): r.depth for r in reach.kin_pairs(found).collect()} == want != {}
    # places hold one, two or three symbols, so a seed's own place may hold others as well
    of_id = s.select("id", F.expr("case when id < 20 then id when id < 30 then id div 2 else id div 3 end").alias("place"))
    place = {r.id: r.place for r in of_id.collect()}
    sizes = {y: len({place[x] for z, x in want if z == y}) for y, _ in want}
    assert {r.seed: r.n for r in reach.kin_sizes(found, of_id, "place").collect()} == sizes


def test_seeds_alike_are_one_seed(spark, monkeypatch):
    """300 symbols of one name that all call it: as seeds of their own they took five words of bits for each symbol."""
    s = spark.range(300).selectExpr("id", "'hot' as name", "'class' as kind", "concat('f', id) as file_path")
    e = spark.range(300).selectExpr("id as from_id", "'hot' as to_name", "'calls' as kind", "1 as line", "cast(null as string) as target_kind")
    rows, cut = [], reach.cut
    monkeypatch.setattr(reach, "cut", lambda df, name: rows.append((t := cut(df, name)).count()) or t)
    found = reach.kin(reach.steps_of(s, e, ("calls",)), 2)
    assert reach.kin_pairs(found).count() == 300 * 299 and found.found.levels.count() == 1
    assert max(rows) <= 600


def imports_plain(s, e):
    own, gives = {r.id: r.file_path for r in s.collect()}, {}
    for r in s.collect():
        gives.setdefault(r.name, set()).add(r.file_path)
    return {(own[r.from_id], f) for r in e.where("kind = 'imports'").collect() for f in gives.get(r.to_name, ()) if f != own[r.from_id]}


def copies(s, e, k=3):
    """The graph with each of its symbols ``k`` times, in as many files."""
    more = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    s = s.withColumn("k", more).withColumn("id", F.col("id") + 1000 * F.col("k")).withColumn("file_path", F.concat("file_path", F.lit("."), F.col("k").cast("string"))).drop("k")
    return s, e.withColumn("k", more).withColumn("from_id", F.col("from_id") + 1000 * F.col("k")).drop("k")


def test_imports_by_classes_of_files(spark):
    s, e = copies(*graph_of(spark, 40, 9))
    plain = imports_plain(s, e)
    files = {r.file_path for r in s.collect()}
    by = graph.alike_files(graph.imports_of(s, e))
    assert sorted((r.from_file, r.to_file) for r in graph.pairs_of(by).collect()) == sorted(plain) and plain
    assert by.links.count() * 3 < len(plain)  # before, all pairs were shuffled
    assert {r.file_path for r in graph.mutual_files(by).collect()} == {a for a, b in plain if (b, a) in plain}
    assert {r.file for r in graph.importers(graph.imports_of(s, e)).collect()} == {a for a, _ in plain}
    seeds = spark.createDataFrame([(f,) for f in sorted(files)[:4]] + [("alone",)], "node string")
    pairs = spark.createDataFrame(sorted(plain), "a string, b string")
    want = {r.node: round(r.score, 9) for r in graph.personal_pagerank(pairs, seeds, rounds=5).collect()}
    assert {r.node: round(r.score, 9) for r in graph.file_ranks(by, seeds, rounds=5).collect()} == want and "alone" in want
    start = spark.createDataFrame([(min(plain)[0],)], "state string")
    steps = pairs.select(F.col("a").alias("state"), F.col("b").alias("next"))
    rows = lambda df: sorted((r.state, r.depth, r.parent or "") for r in df.collect())
    assert rows(evaluation.reachable(start, graph.imports_of(s, e))) == rows(evaluation.reachable(start, steps))


def test_users_by_name_and_by_class(spark):
    s, e = copies(*graph_of(spark))
    met = resolved(e, s.withColumn("language", F.lit("py"))).collect()
    got = {r.file_path: r.in_degree for r in graph.file_in_degrees(s, e).collect()}
    calls = {(r.to_file, r.from_id) for r in met if r.kind == "calls"}
    assert got == {f: len({i for g, i in calls if g == f}) for f, _ in calls} != {}
    own = {r.id: r.file_path for r in s.collect()}
    hits = {(r.to_id, r.from_id) for r in met if own[r.to_id].startswith("p1/") and not own[r.from_id].startswith("p1/")}
    assert {r.id: r.users for r in graph.api_surface(s, e, "p1/").collect()} == {x: len({i for y, i in hits if y == x}) for x, _ in hits} != {}


def test_hashing_many_strings_holds_few_of_them():
    import tracemalloc

    from strataloom.functions.hashing import fnv1a, fnv1a_each

    data = [b"%d" % i for i in range(10_000)]
    tracemalloc.start()
    got = fnv1a_each(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [fnv1a(x) for x in data]
    assert peak < 16 << 20  # before, 4,096 places of eight bytes for each of them


def test_a_batch_of_documents_is_bounded(spark):
    from strataloom.operators import change, store

    s, e = graph_of(spark)
    before = spark.conf.get(store.BATCH_CONF)
    try:
        spark.conf.set(store.BATCH_CONF, store.BATCH_DEFAULT)
        change.fingerprints(s.selectExpr("*", "'py' as language", "'' as signature"), e)
        assert spark.conf.get(store.BATCH_CONF) == str(store.BATCH_ROWS)
    finally:
        spark.conf.set(store.BATCH_CONF, before)
