import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailquarry.functions import text as T
from mailquarry.operators import evaluation as E
from mailquarry.operators import facets as A
from mailquarry.operators import messages as M
from mailquarry.operators import timestamps
from mailquarry.operators import retrieval as R
from mailquarry.plans import search


def micros(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    "text,order,site,want",
    [
        ("Mon, 11 Jan 1999 23:32:32 -0600", "mdy", None, micros(1999, 1, 12, 5, 32, 32)),
        ("2001-03-13T05:12:19-05:00[America/Chicago]", None, None, micros(2001, 3, 13, 10, 12, 19)),
        ("1999-01-05 22:27:18 America/Chicago", None, None, micros(1999, 1, 6, 4, 27, 18)),
        ("12. März 1999 04:51:37", "dmy", "Europe/Berlin", micros(1999, 3, 12, 3, 51, 37)),
        ("02/03/99 12:15 AM", "mdy", "UTC", micros(1999, 2, 3, 0, 15)),
        ("02/03/99 12:15 AM", "dmy", "UTC", micros(1999, 3, 2, 0, 15)),
        ("20000203T124032Z\r", None, None, micros(2000, 2, 3, 12, 40, 32)),
        ("915821761", None, None, 915821761000000),
        ("915947501031", None, None, 915947501031000),
        ("1999-04-04 02:15:00", "mdy", "America/Chicago", None),
        ("10/29/2000 01:30:13", "mdy", "America/Chicago", None),
        ("1999-01-24", "mdy", "America/Chicago", None),
        ("1999-01-24 10:00", "mdy", None, None),
        ("2001-02-30 10:15:00Z", None, None, None),
        ("Jan 3, 2001 11:39:07 PM XQZ", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
    ],
)
def test_readings(text, order, site, want):
    _, found = timestamps.readings(text, order, site)
    assert [us for _, us in found] == ([] if want is None else [want])


def test_mixture_learns_an_undeclared_order_and_marks_ambiguity(spark):
    rows = [(f"a{i}", "25/12/1999 10:00Z", "s1", i) for i in range(40)] + [("x", "03/04/1999 10:00Z", "s1", 90), ("x", "04/04/1999 10:00Z", "s1", 91), ("y", "03/04/1999 10:00Z", "s2", 92), (None, "x", "s1", 93), ("z", None, None, 94)]
    sources = spark.createDataFrame([("s9", "UTC", "mdy")], "source string, zone string, date_order string")
    out = {r["id"]: r for r in timestamps.normalise(spark.createDataFrame(rows, "id string, date_text string, source string, arrival bigint"), sources).collect()}
    assert out["x"]["status"] == "resolved" and out["x"]["utc_us"] == micros(1999, 4, 3, 10, 0) and out["x"]["format"] == "dmy"
    assert out["y"]["status"] == "ambiguous" and out["y"]["utc_us"] is None
    assert out["z"]["status"] == "unreadable" and None not in out and len(out) == 43
    empty = spark.createDataFrame([], "id string, date_text string, source string, arrival bigint, zone int")
    assert timestamps.normalise(empty, sources).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("Re: Fw:  a   deal ", "new\n> old", "Hall, Steve C. <x@y>", "califronia")], "s string, b string, n string, w string")
    r = df.select(T.normalise_subject(F.col("s")).alias("s"), T.is_forward(F.col("s")).alias("f"), T.split_quoted(F.col("b")).alias("q"), T.display_name(F.col("n")).alias("n"), T.one_edit(F.col("w"), F.lit("california")).alias("e"), T.one_edit(F.lit("abcd"), F.lit("badc")).alias("e2"), T.csv_cell(F.lit("=1+1")).alias("c")).first()
    assert (r["s"], r["f"], r["q"]["new_text"], r["q"]["quoted_text"], r["n"], r["e"], r["e2"], r["c"]) == ("a deal", True, "new", "> old", "Steve C. Hall", True, False, "'=1+1")


def test_components_and_tag_fold(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("f", "e")], "id string, parent string")
    got = dict(M.components(v, e).collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "e", "g": "g"}
    many = [f"t{i}" for i in range(16)]
    rows = [("m", 1, "replace", many, [], "u"), ("m", 2, "patch", ["zz"], [], "v"), ("m", 2, "patch", ["zz"], [], "v"), ("n", 1, "patch", [" Hot ", "bad tag!"], ["x"], "u"), ("o", 1, "patch", ["a"], [], "u"), ("o", 2, "replace", [], None, None), (None, 1, "patch", ["a"], [], "u")]
    ev = spark.createDataFrame(rows, "email_id string, seq bigint, op string, add_tags array<string>, remove_tags array<string>, tagged_by string")
    out = {r["email_id"]: (r["tags"], r["tagged_by"]) for r in A.tag_fold(ev).collect()}
    assert out == {"m": (",".join(sorted(many)), "u"), "n": ("hot", "u")}


def test_metrics_by_hand(spark):
    runs = spark.createDataFrame([("m", "q", 1, "a"), ("m", "q", 2, "b")], "method string, query_id string, rank int, id string")
    qrels = spark.createDataFrame([("q", "b", 3, "human"), ("q", "b", 0, "llm"), ("q", "c", 1, "llm"), ("q", "d", None, "llm")], "query_id string, doc_id string, grade int, source string")
    r = E.metrics(runs, E.authoritative(qrels)).first()
    assert (r["mrr"], r["recall"], r["ndcg"]) == (0.5, 0.5, pytest.approx(7 / 1.584963 / (7 + 1 / 1.584963), abs=1e-5))


def test_query_parser():
    q = search.parse('raptor from:A@b.c after:2001-07-01 "hiding losses" before:2001-13-45 to: foo:bar')
    assert q.terms == ("raptor", "foo:bar") and q.phrases == ("hiding losses",) and q.values == {"from": ("a@b.c",)}
    assert q.after == dt.date(2001, 7, 1) and q.before is None and len(q.warnings) == 2
    assert search.parse("x" * 600).warnings and search.parse('"open').phrases == ("open",)
    assert search.page_offset(search.page_token(40)) == 40 and search.page_offset("%%") == 0


def docs_of(spark, rows):
    """Messages for a search from (id, at, from_addr, to_addrs, cc_addrs, subject, body)."""
    df = spark.createDataFrame(rows, "id string, at timestamp, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, body string")
    return df.withColumns({"message_id": F.col("id"), "from_name": F.lit(None).cast("string"), "has_attachment": F.lit(None).cast("boolean"), "duplicate_count": F.lit(None).cast("int"), "folder": F.lit("inbox")})


def test_search_pages_and_filters(spark):
    rows = [(f"{i:02d}", dt.datetime(2001, 1, 1 + i % 28), "a@x", ["b@y"], [], "gas deal" if i % 2 else "power", f"credit line {i}") for i in range(40)] + [("zz", None, None, None, None, None, None)]
    docs = docs_of(spark, rows)
    queries = [("q1", "credit line"), ("q2", '"gas deal" after:2001-01-20'), ("q3", "from:nobody@x"), ("q4", "from:a@x before:2001-01-03"), ("q5", None), ("q6", 'to:b subject:deals cc:"c d"'), (None, "credit")]
    tags = spark.createDataFrame([("03", "hot,new")], "email_id string, tags string")
    for method in ("hybrid", "bm25", "vector"):
        found = search.find(docs, search.asked(spark.createDataFrame(queries, "query_id string, query string")), method)
        got = {}
        for n in (1, 2):
            for r in search.hits(found, docs, tags, n, 20).collect():
                got.setdefault(r["query_id"], []).append(r)
        assert {r["id"] for r in got["q1"]} == {f"{i:02d}" for i in range(40)} and {r["tags"] for r in got["q1"] if r["id"] == "03"} == {"hot,new"}
        assert {r["id"] for r in got["q2"]} == {r[0] for r in rows if r[5] == "gas deal" and r[1] >= dt.datetime(2001, 1, 20)}
        assert not got.keys() & {"q3", "q5", "q6"}
        if method != "vector":
            assert [r["id"] for r in sorted(got["q4"], key=lambda r: r["rank"])] == ["02", "30", "01", "29", "00", "28"] and got["q4"][0]["total"] == 6
    assert search.find(docs.limit(0), found.asked).fused.count() == 0


def test_picked_filters_and_tokens(spark):
    docs = docs_of(spark, [(i, dt.datetime(2001, 1, 1), "a@x", [], [], "s", "b") for i in "abc"]).withColumn("has_attachment", F.col("id") == "a")
    tags = spark.createDataFrame([("b", "hot,new")], "email_id string, tags string")
    ids = lambda **k: {r["id"] for r in search.restrict(docs, search.Structured(**k), tags).collect()}
    assert ids(tags=("hot",)) == {"b"} and ids(tags=("none",)) == set() and ids(has_attachment=False) == {"b", "c"} and ids(folders=("inbox",)) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        search.Structured(tags=tuple("abcdefghijklmnopqr"))
    assert search.page_token(20) == "eyJvIjoyMH0" and [search.page_offset(x) for x in ("eyJvIjoyMH0", "eyJvIjotMX0", "", "é", "e30")] == [20, 0, 0, 0, 0]
    kinds = [(c.kind, c.value) for c in search.chips('gas from:A@b "two words" "open after:2001-1 before:2001-01-02 subject:x cc:')]
    assert kinds == [("text", "gas"), ("person", "A@b"), ("phrase", "two words"), ("unknown", "open after:2001-1 before:2001-01-02 subject:x cc:")]
    assert [c.kind for c in search.chips("after:2001-1 before:2001-01-02 subject:x cc:")] == ["unknown", "date", "text", "unknown"]
    assert search.merged({"from": ["a"], "after": "x", "cc": []}, {"from": ["b", "a"], "after": None, "has_attachment": False}) == {"from": ["a", "b"], "after": "x", "has_attachment": False}
    assert search.filter_count({"from": ["a", "b"], "after": "x"}) == 3
    cache, made = search.Results(most=1, clock=lambda: 0.0), []
    make = lambda: made.append(1) or search.Found(docs, docs, docs)
    cache.get(("a",), 1, make), cache.get(("a",), 2, make)
    cache.changed()
    cache.get(("a",), 2, make)
    assert len(made) == 2


def test_marks_are_escaped(spark):
    docs = docs_of(spark, [("a", None, None, None, None, "amp & <b>", "x" * 400 + " lt gas &lt; gas " + "word " * 60 + "gas")])
    asked = search.asked(spark.createDataFrame([("q", "amp gas lt")], "query_id string, query string"))
    r = R.highlight(docs, spark.createDataFrame([("q", "a")], "query_id string, id string"), asked).first()
    assert r["subject_mark"] == "<em>amp</em> &amp; &lt;b&gt;"
    first, second = r["fragments"].split(" ... ")
    assert "<em>lt</em> <em>gas</em> &amp;<em>lt</em>; <em>gas</em>" in first and second.endswith("<em>gas</em>") and len(second) <= 169
    assert R.edit_distance("califronia", "california") == 1 and R.edit_distance("ca", "abc") == 2 and R.edit_distance("", "ab") == 2


def test_archive_sources(spark, tmp_path):
    from mailquarry.sources import archive

    for name, raw in {"allen-p/inbox/1.": b"From: Al <a@b.c>\r\nTo: /o=x/cn=y@b.c, q@r.s\r\nDate: Mon, 14 May 2001 16:39:00 -0700\r\nMessage-ID: <m1>\r\nSubject: Deal\r\n\r\nhi \xe9\r\n", "allen-p/sent/2.": b"Subject: x\nDate: not a real date\n\nbody\n"}.items():
        (tmp_path / "m" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / name).write_bytes(raw)
    got = {r["folder"]: r for r in archive.read_maildir(spark, str(tmp_path / "m")).collect()}
    assert got["inbox"]["mailbox"] == "allen-p" and got["inbox"]["message_id"] == "m1" and "q@r.s" in got["inbox"]["to_addrs"]
    assert set(got["sent"]["reasons"]) == {"date-unparseable", "message-id-missing"}
    t = archive.Versions(spark, str(tmp_path / "v"), "mails")
    df = spark.range(5)
    assert t.point(t.write(df, 5)) is None and t.create() is None and t.point(1) == 1
    assert t.read().count() == 5 and t.snapshot(str(tmp_path / "snap")) == 5
    assert t.restore(str(tmp_path / "snap")) == 2 and t.current() == 1
    with pytest.raises(ValueError):
        t.write(df, 6)
    assert t.versions() == [1, 2] and t.restore(str(tmp_path / "snap"), 7) == 7
    with pytest.raises(ValueError):
        t.restore(str(tmp_path / "snap"), 7)
    assert archive.write_jsonl(df, str(tmp_path / "j")) == 5 and archive.read_jsonl(spark, str(tmp_path / "j"), "id bigint").count() == 5
    (tmp_path / "x").write_bytes(b"x")
    with pytest.raises(ValueError):
        archive.set_aside(spark, str(tmp_path / "x"), "00")
    assert (tmp_path / "x.bad").exists() and archive.marker("d", "dev", 5) == "d:dev:5" and archive.marker("d", "full") == "d:full"


def test_messages_are_parsed_whole():
    from mailquarry.sources import archive

    html = b"From: a@b.c\nBcc: x@y.z\nContent-Type: multipart/alternative; boundary=q\n\n--q\nContent-Type: text/html\n\n<b>hi</b>\n--q--\n"
    r = archive.parse_message("box/sub/deep/1.", html)
    assert (r["body"], r["bcc_addrs"], r["folder"], r["mailbox"]) == ("", ["x@y.z"], "sub/deep", "box")
    plain = archive.parse_message("box/1.", b"From: A <a@b.c>\nSubject: it\x01,s\nDate: Mon, 14 May 2001 16:39:00\n\nnew \x01,\x02\n> old\n")
    assert (plain["body"], plain["quoted_text"], plain["folder"], plain["from_name"], plain["has_attachment"]) == ("new ’", "> old", "", "A", False)
    assert plain["date_utc"].isoformat() == "2001-05-14T16:39:00+00:00" and plain["reasons"] == ["message-id-missing"]
    assert archive.addresses(["A <a@b.c>, B <b@c.d>"]) == ["a@b.c", "b@c.d"] and archive.addresses(["see r@s.tt or R@s.tt"]) == ["r@s.tt"]


def test_streams(spark, tmp_path):
    from mailquarry.streaming import feeds

    rows = [("a", dt.datetime(2001, 1, 1), "m"), ("a", dt.datetime(2001, 1, 2), "m"), ("b", dt.datetime(2001, 1, 3), "m")]
    df = spark.createDataFrame(rows, "id string, ingested_at timestamp, mailbox string")
    df.write.parquet(str(tmp_path / "in"))
    stream = feeds.mail_stream(spark, str(tmp_path / "in"), df.schema)
    q = feeds.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["id"] for r in spark.table("seen").collect()} == {"a", "b"}


def test_the_declared_order_is_a_likelihood(spark):
    rows = [(f"a{i}", "02/03/1999 10:00Z", "us", i) for i in range(5)] + [("b", "25/12/1999 10:00Z", "us", 9), ("c", "02/03/1999 10:00Z", "eu", 10), ("d", "3/3/99 10:00Z", "eu", 11), ("e", "123", "eu", 12)]
    sources = spark.createDataFrame([("us", "UTC", "mdy"), ("eu", "UTC", "dmy")], "source string, zone string, date_order string")
    out = {r["id"]: r for r in timestamps.normalise(spark.createDataFrame(rows, "id string, date_text string, source string, arrival bigint"), sources).collect()}
    assert {out[f"a{i}"]["utc_us"] for i in range(5)} == {micros(1999, 2, 3, 10, 0)} and out["a0"]["posterior"] < 1
    assert out["b"]["status"] == "mistyped" and out["b"]["utc_us"] is None and out["e"]["status"] == "no_unit"
    assert out["c"]["utc_us"] == micros(1999, 3, 2, 10, 0) and out["d"]["utc_us"] == micros(1999, 3, 3, 10, 0)


def test_stream_counts_and_tags_equal_batches(spark, tmp_path):
    from mailquarry.streaming import feeds

    mails = [("a", dt.datetime(2001, 1, 31, 23), "m"), ("b", dt.datetime(2001, 2, 1), "m"), ("c", dt.datetime(2001, 1, 2), None), ("d", None, "m")]
    df = spark.createDataFrame(mails, "id string, ingested_at timestamp, mailbox string")
    df.write.parquet(str(tmp_path / "mails"))
    counts = feeds.monthly_counts(feeds.mail_stream(spark, str(tmp_path / "mails"), df.schema))
    counts.writeStream.format("memory").queryName("months").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("months").collect()} == {("2001-01", "m", 1), ("2001-02", "m", 1), ("2001-01", None, 1)}

    many = [f"t{i:02d}" for i in range(17)]
    rows = [("m", 3, "patch", ["c"], ["a"], "w"), ("m", 1, "replace", ["a", "b"], [], "u"), ("m", 1, "replace", ["a", "b"], [], "u"), ("n", 1, "replace", many, [], "u"), ("n", 2, "patch", ["x"], [], None), ("m", 2, "patch", ["d"], ["b"], "v"), ("o", 1, "patch", ["x"], [], "u"), ("o", 2, "replace", [], None, "u")]
    schema = "email_id string, seq bigint, op string, add_tags array<string>, remove_tags array<string>, tagged_by string"
    events = spark.createDataFrame(rows, schema)
    for i in range(0, len(rows), 3):  # late and repeated events come in other batches
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "tags"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "tags"))
    feeds.tag_states(stream).writeStream.format("memory").queryName("tags").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    last: dict = {}
    for r in spark.table("tags").collect():
        last[r["email_id"]] = (r["tags"], r["tagged_by"])
    assert {k: v for k, v in last.items() if v[0]} == {r["email_id"]: (r["tags"], r["tagged_by"]) for r in A.tag_fold(events).collect()} == {"m": ("c,d", "w"), "n": ("x", None)}
