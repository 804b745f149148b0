import base64
import random

import pytest
from pyspark.sql import functions as F

from mailquarry.llm import chunking, leakage, namelinks, nearcopies, newtext, pii, tokenizer, truncation
from mailquarry.llm.queries import TOKENIZERS

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_tokenizer_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tokenizer.Encoder(RANKS, tokenizer.BYTE_LEVEL_PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    want = tiktoken.Encoding("own", pat_str=tokenizer.BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    letters = list("ab  \n\t\r\x1c\x85 ​　'sé́١½²漢😀�<|endoftext|>_-9!")
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert enc.encode(s) == want.encode_ordinary(s)
    for s in ("a" * 3000, " " * 2000, "ab" * 700):
        assert enc.encode(s) == want.encode_ordinary(s)
        assert tokenizer.merge_heap(s.encode(), ranks) == tokenizer.merge_scan(s.encode(), ranks)
    df = spark.createDataFrame([(1, "hello", "x"), (1, "hello", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in tokenizer.encode_column(df, "doc_id", "text", RANKS, tokenizer.BYTE_LEVEL_PATTERN).collect())
    assert got == [(0, want.encode_ordinary("a")), (1, want.encode_ordinary("hello")), (1, want.encode_ordinary("hello")), (2, []), (3, [])]


def test_pieces_cover_the_text_within_the_limit(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé ") for _ in range(rng.randint(1, 9))) + rng.choice([".", "", "\n", "\n\n", "! "]) for _ in range(900))
    for size, over in ((50, 10), (200, 0), (333, 60), (7, 6)):
        pieces = chunking.cut_text(text, size, over)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
            assert b - a <= size and a < b and c <= b < d and b - c <= over
    assert chunking.cut_text("x" * 100, 30, 5)[-1][1] == 100
    items = spark.createDataFrame([("a", text), ("a", text), ("b", "short"), ("c", None), (None, text)], "id string, text string")
    specs = spark.createDataFrame([(1, 200, 20), (2, 10**6, 5), (None, 5, 1)], "spec_id int, max_chars int, overlap_chars int")
    for step in (1 << 18, 1000):
        rows = sorted(chunking.split_items(items, specs, range_chars=step).collect(), key=lambda r: r["piece_no"])
        assert {(r["spec_id"], r["id"]) for r in rows} == {(1, "a")} and rows[0]["start_pos"] == 0 and rows[-1]["end_pos"] == len(text)
        assert all(r["piece"] == text[r["start_pos"] : r["end_pos"]] and len(r["piece"]) <= 200 for r in rows)
        assert all(y["start_pos"] <= x["end_pos"] < y["end_pos"] for x, y in zip(rows, rows[1:]))
    assert [tuple(r) for r in chunking.oversized(items, specs).collect()] == [(1, "a")]


def test_files_are_cut_by_ranges(spark, tmp_path):
    text = "".join(f"Satz {i} über Öl und Gas. " + ("\n\n" if i % 7 == 0 else "") for i in range(800))
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    rows = sorted(chunking.split_files(spark, [str(path)], 300, 40, range_bytes=4000).collect(), key=lambda r: r["piece_no"])
    assert rows[0]["start_pos"] == 0 and rows[-1]["end_pos"] == len(text)
    assert all(r["piece"] == text[r["start_pos"] : r["end_pos"]] and len(r["piece"]) <= 300 for r in rows)
    assert all(y["start_pos"] <= x["end_pos"] < y["end_pos"] for x, y in zip(rows, rows[1:]))


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(25)]
    rows = []
    for k, b in enumerate(base):
        rows.append((f"a{k:02d}", f"t{k}", " ".join(b)))
        for v in range(3):
            c = list(b)
            for _ in range(rng.randint(0, len(c) // 9)):
                i = rng.randrange(len(c))
                c[i : i + rng.randint(0, 1)] = [rng.choice(words)]
            rows.append((f"{'bcd'[v]}{k:02d}", rng.choice([None, f"t{k}", f"u{k}{v}"]), " ".join(c)))
    rows += [rows[0], ("e1", None, None), ("e2", "x", ""), (None, "x", rows[0][2]), ("e3", "x", "too short")]
    df = spark.createDataFrame(rows, "id string, thread string, text string")
    sets = {i: (t, {tuple(x.split()[j : j + 3]) for j in range(len(x.split()) - 2)}) for i, t, x in rows if i and x and len(x.split()) >= 30}
    want = {
        (a, b) for a in sets for b in sets if a < b and (sets[a][0] is None or sets[b][0] is None or sets[a][0] != sets[b][0])
        if len(sets[a][1] & sets[b][1]) >= 0.6 * len(sets[a][1] | sets[b][1]) - 1e-9
    }
    got = {tuple(r) for r in nearcopies.near_copies(df).collect()}
    assert got == want and len(want) > 20
    classes = {r["id"]: r for r in nearcopies.copy_classes(df).collect()}
    assert set(classes) == set(sets)
    links = {i: sum(i in p for p in want) for i in sets}
    assert {i: r["n_links"] for i, r in classes.items()} == links
    same = lambda a, b: len(sets[a][1] & sets[b][1]) >= 0.6 * len(sets[a][1] | sets[b][1]) - 1e-9
    for a in sets:
        assert classes[a]["class_id"] == min(b for b in sets if classes[b]["class_id"] == classes[a]["class_id"])
    assert all(classes[a]["class_id"] == classes[b]["class_id"] for a, b in want)
    assert all(classes[a]["class_id"] == a or any(same(a, b) for b in sets if b != a) for a in sets)
    assert nearcopies.near_copies(df.limit(0)).count() == 0


def test_long_lists_are_joined_leaf_by_leaf(spark, monkeypatch):
    rng = random.Random(1)
    head = [f"h{i}" for i in range(60)]
    rows = [(f"m{k:03d}", f"t{k}", " ".join(head + [f"x{rng.randint(0, 9)}" for _ in range(k % 9)])) for k in range(60)]
    monkeypatch.setattr(nearcopies, "LEAF", 8)
    df = spark.createDataFrame(rows, "id string, thread string, text string")
    assert nearcopies.near_copies(df).count() == 60 * 59 // 2


def circuit(rng, letters):
    """A text with every run of three of the letters once, in random order: an Euler circuit over the runs of two."""
    ways = {(a, b): rng.sample(letters, len(letters)) for a in letters for b in letters}
    path, out = [(letters[0], letters[0])], []
    while path:
        left = ways[path[-1]]
        if left:
            path.append((path[-1][1], left.pop()))
        else:
            out.append(path.pop()[1])
    return [letters[0], *out[::-1]]


def near_pairs(rows):
    grams = {i: (t, {tuple(x.split()[j : j + 3]) for j in range(len(x.split()) - 2)}) for i, t, x in rows}
    return {(a, b) for a in grams for b in grams if a < b and grams[a][0] != grams[b][0] and len(grams[a][1] & grams[b][1]) >= 0.6 * len(grams[a][1] | grams[b][1]) - 1e-9}


def test_copies_that_share_no_longer_runs_are_found(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for k in range(5):
        letters = [f"{x}{k}" for x in "abcdef"]
        for v in range(4):
            w = circuit(rng, letters)
            rows.append((f"m{k}{v}", f"t{k}{v}", " ".join(w[: len(w) - rng.randint(0, 60)])))
    df = spark.createDataFrame(rows, "id string, thread string, text string")
    want = near_pairs(rows)
    assert {tuple(r) for r in nearcopies.near_copies(df).collect()} == want and len(want) > 20
    # the same from lists that are spread over the tasks, and without files of vectors
    monkeypatch.setattr(nearcopies, "LEAF", 2)
    monkeypatch.setattr(nearcopies, "LONG", 1)
    assert {tuple(r) for r in nearcopies.near_copies(df).collect()} == want
    monkeypatch.setattr(nearcopies, "_kept_vectors", lambda vectors: None)
    assert {tuple(r) for r in nearcopies.near_copies(df).collect()} == want


def test_texts_of_which_there_are_many_copies_are_looked_for_once(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(3)]
    texts.append(texts[0] + " k l m")
    rows = [(f"m{k}{v}", f"t{k}{v}", t) for k, t in enumerate(texts) for v in range(4)]
    got = [tuple(r) for r in nearcopies.near_copies(spark.createDataFrame([*rows, rows[0], (None, "x", texts[0])], "id string, thread string, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == near_pairs(rows) and len(got) == 4 * 6 + 16


def test_near_copies_shuffle_less_than_the_texts(spark):
    rng = random.Random(13)
    phrases = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(6)) for _ in range(4000)]
    rows = []
    for k in range(3000):
        text = rng.sample(phrases, 25)
        rows.append((f"m{k}", f"t{k}", " ".join(text)))
        if k % 5 == 0:
            rows.append((f"n{k}", f"u{k}", " ".join([*text[:10], "x y", *text[11:]])))
    df = spark.createDataFrame(rows, "id string, thread string, text string").repartition(4).persist()
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert nearcopies.near_copies(df).count() == 600
    assert written() - before < 2 * sum(len(t) for _, _, t in rows)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(12)] + [(99, "one two"), (98, None)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocab) for _ in range(60)]
        if d % 3 == 0:
            src = items[d % 12][1].split()
            k, n, at = rng.randrange(18), rng.randint(7, 13), rng.randrange(40)
            w[at : at + n] = [x.upper() for x in src[k : k + n]]
        docs.append((d, rng.choice([", ", " ", "_"]).join(w)))
    docs += [(200, None), (201, ""), (0, docs[0][1])]
    grams = lambda t: {tuple(t[i : i + 10]) for i in range(len(t) - 9)}
    split = lambda s: s.lower().replace("_", " ").replace(",", " ").split() if s else []
    want = {(d, i) for d, t in docs for i, s in items if grams(split(t)) & grams(split(s))}
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_passages(a, b).collect()} == want and want
    assert leakage.leaked_passages(a.limit(0), b).count() == 0 == leakage.leaked_passages(a, b.limit(0)).count()


def test_proximity_matches_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(80)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(8, 28))]) for i in range(10)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(40)]
        if d % 2 == 0:
            part = list(items[d % 10][1])
            for _ in range(rng.randint(0, 7)):
                i = rng.randrange(len(part))
                part[i : i + rng.randint(0, 2)] = [rng.choice([*vocab, "zz"]) for _ in range(rng.randint(0, 2))]
            w[10:10] = part
        docs.append((d, w))

    def near(item, doc, least=10, reach=15, slop=5):
        best = 0
        for low in range(-len(item), len(doc)):
            hit = [any(0 <= low + d + i < len(doc) and doc[low + d + i] == x for d in range(slop + 1)) for i, x in enumerate(item)]
            best = max([best, *(sum(hit[s : s + reach]) for s in range(len(item)))])
        return best if best >= least else 0

    want = {(d, i, n) for d, t in docs for i, s in items if len(s) >= 10 and (n := near(s, t))}
    a = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.near_passages(a, b).collect()} == want and len(want) > 10
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert {tuple(r) for r in leakage.near_passages(a, b).collect()} == want
    report = {r["item_id"]: r["n_near_docs"] for r in leakage.leak_report(a, b).collect()}
    assert report == {i: sum(x[1] == i for x in want) for i, _ in items}


def test_truncation(spark):
    rows = [
        (1, "All is well here. We agreed on the terms.", "s"), (2, "All is well here. We agreed on the te", "s"), (3, "Please call me.\n\nBest regards,\nMaren", "s"), (4, "The list:\n\n- 25 units at Carrow Hub", "s"),
        (5, "See the page.\n\nhttp://x.example/a", "s"), (6, "It is done.\n\nSent from my handheld", "s"), (7, None, "s"), (8, "", None), (9, "  \n", "s"), (10, "Our exposure through th�", "s"), (11, "It was about the positi=\n", None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r[0] for r in truncation.truncated(df).collect()} == {2, 10, 11}
    assert {r["text"] for r in truncation.strict_prefixes(df, "doc_id", "text").collect()} == {rows[1][1]}
    assert {r["source"]: r["n_cut"] for r in truncation.truncation_by_source(df).collect()} == {"s": 2, None: 1}
    assert truncation.truncated(df.limit(0)).count() == 0


def test_truncation_sees_long_last_paragraphs_and_short_texts(spark):
    block = "Best regards,\nMaren\n" + "\n".join(f"Haldenmark-Department-{k}-" + "x" * 90 for k in range(5))
    rows = [(1, f"All is well here.\n\n{block}", "s"), (2, "- item twelve", "s"), (3, "- item twelve is late.", "s"), (4, "All is well here.\n\n" + "We agreed on the terms and wait for the other desk. " * 2000 + "Then the", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {(r["doc_id"], r["by_prefix"]) for r in truncation.judged(df).where("cut").collect()} == {(2, True), (4, False)}


def test_personal_data():
    names = pii.Names({"maren": (9, 0), "will": (5, 0), "mark": (5, 0), "yarumison": (0, 9), "osamann": (0, 4), "rosalind": (5, 0)})
    text = (
        "Dear Maren,\nWill the grant help? Mark the deal. Mark mentioned it to Dr. Quilwen and M. Yarumison's team.\nCall 212/555-0120 x3455 or +49 30 23125 400, mail x dot y at z dot example or a.b@c.example.\n"
        "Her SSN is 945-59-5293, passport ZZ8910093, not invoice 2001-555-9949 or contract 488-19-915220.\nShip to 7025 Tamarind Street, Suite 3, Fenwick, TX 00417.\nFrom: Osamann, Rosalind\nKelfiway Storage"
    )
    got = [(what, text[s:e]) for s, e, what in pii.find(text, names)]
    assert [x for t, x in got if t == "name"] == ["Maren", "Mark", "Quilwen", "M. Yarumison", "Osamann, Rosalind"]
    assert [x for t, x in got if t == "phone"] == ["212/555-0120 x3455", "+49 30 23125 400"]
    assert [x for t, x in got if t == "email"] == ["x dot y at z dot example", "a.b@c.example"]
    assert [x for t, x in got if t == "id_number"] == ["945-59-5293", "ZZ8910093"]
    assert [x for t, x in got if t == "address"] == ["7025 Tamarind Street, Suite 3, Fenwick, TX 00417"]
    assert pii.mask("Dear Maren,", pii.find("Dear Maren,", names)) == "Dear [NAME],"
    assert pii.find(None, names) == [] == pii.find("", names) and pii.mask(None, []) is None
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432")


def test_a_large_name_model_is_joined_by_word(spark, monkeypatch):
    model = spark.createDataFrame([("maren", 9, 0), ("yarumison", 0, 9), ("rosalind", 5, 0)], "word string, given bigint, surname bigint")
    rows = [("a", 1, "Dear Maren's team, ask Rosalind Yarumison.", "Hi Maren"), ("b", 2, None, ""), ("c", 3, "no names here", None), (None, 4, "Maren", None), ("a", 5, "other", None)]
    df = spark.createDataFrame(rows, "id string, arrival bigint, body string, quoted_text string")
    small, masked = pii.spans(df, model).collect(), pii.masked(df, model).collect()
    monkeypatch.setattr(pii, "BROADCAST_NAME_WORDS", 1)
    assert sorted(pii.spans(df, model).collect()) == sorted(small) and len(small) == 3
    assert {r["id"]: r["body"] for r in pii.masked(df, model).collect()} == {r["id"]: r["body"] for r in masked} == {"a": "Dear [NAME]'s team, ask [NAME].", "b": None, "c": "no names here"}


def states(body, names=("maren", "yarumison")):
    return [i + 1 for i, (x, s) in enumerate(zip(body.split("\n"), newtext.line_states(body, set(names)))) if s == newtext.NEW and x.strip()]


def test_new_lines_by_form():
    assert states("Hi Bo,\nall fine.\n\nThanks,\nMaren\n\n-----Original Message-----\nFrom: Bo\nSent: x\n\nold text") == [1, 2]
    assert states("Bo wrote:\n>first part\nMy answer.\n> second\n\n-- \nMaren Yarumison\nTrader") == [3]
    assert states("> old\n>\n\nNew at the end.\n/Maren") == [4]
    assert states("On 2001-01-01\nBo <b@x>\nwrote:\n> old\n\nYes.\n\n*****\nCONFIDENTIALITY NOTICE: only for\nthe recipient.") == [6]
    assert states("") == [] and states("\n \n") == []


def test_unmarked_history_is_found(spark):
    first = "I would rather match the golf outing now than have the help desk adjust the cafeteria menu on June fourteen please"
    rows = [
        ("a", "Bo", "bo@x", "deal", first, None, "2001-01-01 10:00Z", None), ("b", "Al", "al@x", "Re: deal", "No, we will wait for another week or so.\n\n" + first, None, "2001-01-02 10:00Z", None),
        ("c", "Al", "al@x", "other", "Something quite else.\n\n" + first, None, "2001-01-03 10:00Z", None), ("b", "Al", "al@x", "Re: deal", "No, we will wait for another week or so.\n\n" + first, None, "2001-01-02 10:00Z", None), ("d", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, from_name string, from_addr string, subject string, body string, quoted_text string, date_text string, source string")
    src = spark.createDataFrame([("s", "UTC", "mdy")], "source string, zone string, date_order string")
    assert {tuple(r) for r in newtext.new_lines(df, src).collect()} == {("a", 1), ("b", 1), ("c", 1), ("c", 3)}


def mails(spark, rows):
    source = spark.createDataFrame([("s", "UTC", "mdy")], "source string, zone string, date_order string")
    return spark.createDataFrame(rows, "id string, from_name string, from_addr string, subject string, body string, quoted_text string, date_text string, source string, thread string"), source


def test_short_answers_above_history_stay(spark):
    old = "I would rather match the golf outing now than have the help desk adjust the cafeteria menu on June fourteen please"
    rows = [
        ("a", "Bo", "bo@x", "deal", f"Dear Al,\n\n{old}", None, "2001-01-01 10:00Z", None, None),
        ("b", "Al", "al@x", "Re: deal", f"Konstantin,\n\nPlease go ahead.\n\n{old}", None, "2001-01-02 10:00Z", None, None),
        ("c", "Al", "al@x", "Re: deal", f"Bo,\n\nWill do.\n\nDear Al,\n\n{old}", None, "2001-01-03 10:00Z", None, None),
    ]
    got = {tuple(r) for r in newtext.new_lines(*mails(spark, rows)).collect()}
    assert got == {("a", 1), ("a", 3), ("b", 1), ("b", 3), ("c", 1), ("c", 3)}


def test_history_is_found_where_a_subject_is_missing(spark):
    t = [" ".join(f"{w}{k}" for k in range(20)) for w in ("golf", "meter", "plant", "desk")]
    rows = [
        ("a", "Bo", "bo@x", "deal", t[0], None, "2001-01-01 10:00Z", None, "t1"), ("b", "Al", "al@x", None, f"No, we wait.\n\n{t[0]}", None, "2001-01-02 10:00Z", None, "t1"),
        ("c", "Bo", "bo@x", "game", t[1], None, "2001-01-01 10:00Z", None, "t2"), ("d", "Al", "al@x", None, f"Something else.\n\n{t[1]}", None, "2001-01-02 10:00Z", None, "t3"),
        ("e", "Bo", "bo@x", None, t[2], None, "2001-01-01 10:00Z", None, "t4"), ("f", "Al", "al@x", "Re: x", f"Yes.\n\n{t[2]}", None, "2001-01-02 10:00Z", None, "t4"),
        ("g", "Bo", "bo@x", None, f"Dear Al,\n\n{t[3]}", None, "2001-01-05 10:00Z", None, "t5"), ("h", "Al", "al@x", "Re: y", f"Yes.\n\n> Dear Al,\n>\n> {t[3]}", None, "2001-01-02 10:00Z", None, "t5"),
    ]
    got = {tuple(r) for r in newtext.new_lines(*mails(spark, rows)).collect()}
    assert got == {("a", 1), ("b", 1), ("c", 1), ("d", 1), ("d", 3), ("e", 1), ("f", 1), ("g", 1), ("g", 3), ("h", 1)}


def test_history_of_the_thread_is_found_first_and_under_any_subject(spark):
    t = [" ".join(f"{w}{k}" for k in range(20)) for w in ("golf", "meter", "plant")]
    rows = [
        ("a", "Bo", "bo@x", "deal", t[0], None, "2001-01-01 10:00Z", None, "t1"),
        ("b", "Al", "al@x", "another matter", f"{t[0]}\n\n{t[1]}", None, "2001-01-02 10:00Z", None, "t1"),
        ("c", "Al", "al@x", "a third matter", f"{t[2]}\n\n{t[0]}", None, "2001-01-03 10:00Z", None, "t1"),
        ("d", "Al", "al@x", "another matter", f"{t[0]}\n\n{t[1]}", None, "2001-01-02 10:00Z", None, "t2"),
    ]
    got = {tuple(r) for r in newtext.new_lines(*mails(spark, rows)).collect()}
    assert got == {("a", 1), ("b", 3), ("c", 1), ("d", 1), ("d", 3)}


def test_name_links(spark):
    rows = [
        (1, "Maren Yarumison", "maren.yarumison@x.example", 9), (2, "Yarumison, Maren K.", "MAREN.YARUMISON@X.EXAMPLE", 1), (3, "Marren Yarumison", "maren_yarumison@x.example", 1), (4, "M. Yarumison", "myarumison@x.example", 1), (5, None, "maren.yarumison@mail.x.example", 1),
        (6, "Oswald Yarumison", "oswald.yarumison@x.example", 5), (7, "YARUMISON MAREN", None, 1), (8, "Kelfiway Storage LLC", "billing@kelfiwaystorage.example", 3), (9, "Storage, Kelfiway", None, 1), (10, None, None, 1), (11, None, None, 1), (12, "Ozzie Yarumison", "oyarumison@x.example", 1), (None, "x", "y", 1),
        # what the nickname is learned from
        (13, "Ozzie Brandgard", "oswald.brandgard@y.example", 1), (14, "Oswald Farnholm", "ozzie.farnholm@z.example", 1), (15, "Oswald Farnholm", "oswald.farnholm@z.example", 1),
    ]
    df = spark.createDataFrame(rows, "mention_id bigint, name_typed string, address string, n_seen int")
    groups: dict = {}
    for r in namelinks.link(df).collect():
        groups.setdefault(r["entity"], set()).add(r["mention_id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5, 7], [6, 12], [8, 9], [10], [11], [13], [14, 15]]
    assert namelinks.linked_pairs(df).count() == 15 + 1 + 1 + 1
    assert namelinks.one_edit("lorpasmroe", "lorpasmore") and not namelinks.one_edit("abcd", "badc")


def test_the_plan_of_links_does_not_repeat_what_made_them(spark):
    rows = [(1, "Maren Yarumison", "maren.yarumison@x.example", 9), (2, "M. Yarumison", "myarumison@x.example", 1), (3, "Marren Yarumison", None, 1)]
    pairs = namelinks.linked_pairs(spark.createDataFrame(rows, "mention_id bigint, name_typed string, address string, n_seen int"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "InMemory" not in plan and "Aggregate" not in plan and "MapInArrow" not in plan
    assert {tuple(r) for r in pairs.collect()} >= {(1, 2)}
