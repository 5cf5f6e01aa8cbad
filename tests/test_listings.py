"""Listings by hand: rows without partner, null keys and values, repeats, empty inputs."""

from pyspark.sql import functions as F

from docweave.operators import citations, listings


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_listings_keep_rows_without_partner(spark):
    df = spark.createDataFrame
    docs = df([(1, 1), (2, 1), (3, 9), (None, 1)], "doc_id int, collection_id int")
    cs, owners = df([(1, "c", 5)], "collection_id int, collection string, owner_id int"), df([(5, "o")], "owner_id int, owner string")
    assert rows(listings.document_list(docs, cs, owners, df([(1,), (1,), (None,)], "doc_id int"))) == [(1, "c", "o", 2), (2, "c", "o", 0), (None, "c", "o", 0)]
    folders = df([("a", None, "A"), ("b", "a", "B"), ("c", "a", "C")], "id string, parent_id string, name string")
    assert rows(listings.folder_counts(folders, df([("b",), ("b",), ("x",)], "folder_id string"))) == [("a", "A", 2, 0), ("b", "B", 0, 2), ("c", "C", 0, 0)]
    placed = df([(1, "/a/"), (2, "/ab/"), (3, "/a/b/"), (4, None), (5, "/%/")], "k int, folder string")
    assert [r[0] for r in rows(listings.in_folders(placed, ["/a"]))] == [1, 3] and rows(listings.in_folders(placed, [])) == [] and [r[0] for r in rows(listings.in_folders(placed, ["/%/"]))] == [5]
    files = df([(1, 10), (1, 11), (3, None)], "owner_id int, size int")
    assert rows(listings.quotas(df([(1,), (2,), (3,)], "owner_id int"), files, 20)) == [(1, 2, 21, True), (2, 0, 0, False), (3, 1, 0, False)]
    assert rows(listings.version_list(df([(1, 2, "failed", 8)], "lineage_id int, version int, status string, author_id int"), df([], "author_id int, author string"))) == [(1, 2, "failed", None)]
    assert rows(listings.servers(df([(1, "s", None), (2, "t", 5)], "server_id int, name string, owner_id int"), owners)) == [(1, "s", "-"), (2, "t", "o")]
    uses = df([(1,), (None,)], "collection_id int")
    assert rows(listings.unused(df([(1,), (2,), (None,)], "collection_id int"), uses)) == [(2,), (None,)]
    assert rows(listings.attachments(df([(1,), (1,)], "conv_id int"), df([(1, "f"), (2, "g")], "conv_id int, file string"))) == [(1, "f")]


def test_totals_and_verdicts(spark):
    df = spark.createDataFrame
    calls = df([(1, 5), (1, None), (None, 2)], "user_id int, tokens int")
    assert rows(listings.token_usage([calls, df([(1, 7)], "user_id int, tokens long")])) == [(1, 12, 3), (None, 2, 1)]
    v = listings.bulk_verdicts(df([(1,), (2,), (6,), (None,)], "k int"), [(F.col("k") % 2 == 0, "even"), (F.col("k") % 3 == 0, "three")])
    assert sorted(map(tuple, v.collect()), key=repr) == [(1, "done"), (2, "failed: even"), (6, "failed: even"), (None, "done")]
    traces = df([(1, True, True), (1, True, False), (1, True, None), (2, True, False), (3, False, False)], "conv_id int, delivered boolean, cited boolean")
    assert rows(listings.trace_utilization(traces)) == [(1, 3, 1, 0.333333, False), (2, 1, 0, 0.0, True), (3, 0, 0, None, False)]
    prompts = df([("p", 1, 5), ("p", 4, 6), ("q", 2, None)], "name string, version int, author_id int")
    assert rows(listings.prompt_versions(prompts, df([(5, "o")], "author_id int, author string"))) == [("p", 2, 4, 5, None), ("q", 1, 2, 3, None)]
    runs = df([(1, "done", "a"), (1, "open", "b"), (1, None, None)], "project_id int, status string, day string")
    assert rows(listings.projects(runs, ["done"])) == [(1, 3, "b", 1)]
    best = listings.leading(df([("g", 3), ("g", 9), ("g", 5)], "g string, v int"), "g", [F.desc("v")], 2)
    assert rows(best) == [("g", 5, 2, False), ("g", 9, 1, True)]
    assert rows(listings.counts_by(df([(1,), (None,), (None,)], "k int"), ["k"])) == [(1, 1), (None, 2)]


def test_files_texts_tools_and_addresses(spark):
    df = spark.createDataFrame
    files = df([(1, "s", "x"), (2, "s", "x"), (3, "t", "x"), (4, "s", None), (5, "s", None)], "doc_id int, scope string, content string")
    assert [(r.scope, r.first_id, r.copies, r.sha256 is None) for r in listings.duplicate_files(files).orderBy("first_id").collect()] == [("s", 1, 2, False), ("s", 4, 2, True)]
    parts = df([(1, 2, "b"), (1, 1, "a"), (1, 3, "  "), (2, 1, None)], "conv_id int, place int, text string")
    assert rows(listings.attachment_texts(parts)) == [(1, "a\nb", None)]
    known, listed = df([(1, "high"), (2, "low"), (4, None)], "tool_id int, risk string"), df([(2, "t"), (3, None)], "tool_id int, title string")
    assert rows(listings.discovered(known, listed)) == [(1, "high", None, False), (2, "low", "t", True), (3, "unset", None, True), (4, "unset", None, False)]
    tools = df([(1, 1, True), (2, 1, False), (3, 2, True), (4, 9, True)], "tool_id int, server_id int, enabled boolean")
    found = listings.available_tools(tools, df([(1, "s", 1), (2, "z", 2)], "server_id int, server string, group_id int"), df([(1, "g", True), (2, "h", False)], "group_id int, grp string, allowed boolean"))
    assert rows(found) == [(1, "s", "g")]
    assert rows(listings.gold_addresses(df([(1, 2, 0), (1, 2, 0), (1, None, 3)], "query_id int, doc_id int, chunk_index int"))) == [(1, "2#0")]


def test_walk_computes_each_layer_once(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "b", "w"), ("b", "c", "y"), ("c", "a", "z"), ("c", "d", "v"), ("d", None, "u")], "src string, dst string, label string")
    kept = []

    def keep(df):
        kept.append(sorted(map(tuple, df.collect())))
        return spark.createDataFrame(kept[-1], df.schema)

    got = citations.forward_walk(spark.createDataFrame([("a",)], "root string"), edges, 4, keep)
    assert rows(got) == [("a", "b", 1, "w"), ("a", "c", 2, "y"), ("a", "d", 3, "v")]
    assert kept == [[("a", "b", 1, "w")], [("a", "c", 2, "y")], [("a", "d", 3, "v")]]
