"""Problem 6: variant spellings of one person or organisation, by noisy-channel attribution.

Spellings that a name and its address confirm together are ranked by how often they were seen; they are
the candidate canonical forms. Every mention is compared with the candidates of a similar surname (or
company word): keys are the word and each of its one-letter deletions, so that any single typing error
meets. The posterior of a candidate is its frequency (the prior) times the likelihoods of the typed name
(exact, typing error, nickname, initial, missing part; given names and nicknames are learned from names whose
address has the same surname) and of the address (one of the forms that the name
may take there, a typing error in one, another house). A mention goes to its maximum posterior, if that
is clear; else it stays with mentions of the same address or spelling.

Defined results: a mention with neither name nor address is an entity of its own; repeated rows of a
mention count once; null mention ids are left out; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.pii import COMPANY as _COMPANY
from mailquarry.llm.pii import TITLES as _TITLES
from mailquarry.llm.pii import fold
from mailquarry.runtime import broadcast_if, cut_lineage

#: A given name stands with at least so many different surnames; rarer ones are taken for typing errors.
MIN_SURNAMES = 3
#: A nickname stands for its name with at least so many surnames; what does so once may be mistyped.
MIN_NICKNAMED = 2
#: Rows of the name model that are sent to every executor; a larger one is joined by shuffling.
BROADCAST_MODEL = 200_000
#: The best candidate must be so many times as likely as the next.
MIN_ODDS = 3.0
#: The least likelihood, without the prior, at which a mention is attached at all.
MIN_LIKELIHOOD = 1e-6
#: Role mailboxes and legal forms.
_ROLES = frozenset("accounts admin billing contact enquiries help hr info invoices mail marketing newsletter noreply no-reply office operations ops orders payments postmaster reception sales service support team webmaster".split())
_LEGAL = frozenset("ag and bv co company corp corporation gmbh inc incorporated limited llc lp ltd plc sa sarl the".split())
def deletions(word: str) -> set[str]:
    """The word and all its one-letter deletions: two words that share one are at most one typing error apart, or two deletions."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 3 else {word}


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def house(address: str | None) -> tuple[str, str]:
    """(local part, domain without leading mail host) of an address, in lower case; empty where there is none."""
    m = re.search(r"([^\s<>@]+)@([^\s<>@]+)", (address or "").lower())
    return (m[1], re.sub(r"^(?:e?mail|mx\d*|smtp|www)\.", "", m[2])) if m else ("", "")


def read_name(name: str | None, given: set[str]) -> tuple[str, str, str]:
    """(given name, first initial, surname) as far as a typed name has them, folded."""
    s = re.sub(r"\(.*?\)|<.*?>|[\"“”]", " ", name or "").strip().strip("'").strip()
    turned = re.fullmatch(r"([^,]+),\s*(.+)", s)
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", f"{turned[2]} {turned[1]}" if turned else s)
    words = [w for w in words if w.rstrip(".").lower() not in _TITLES or len(w.rstrip(".")) < 2]
    parts = [(fold(w.rstrip(".")), w) for w in words]
    if not parts:
        return "", "", ""
    if len(parts) == 1:
        return ("", "", parts[0][0]) if parts[0][0] not in given else (parts[0][0], parts[0][0][0], "")
    initials = [i for i, (p, w) in enumerate(parts) if len(p) == 1 or (len(p) == 2 and w.isupper() and len(parts) == 2 and i == 0)]
    full = [i for i in range(len(parts)) if i not in initials]
    if len(full) == 1:
        return "", parts[initials[0]][0][0] if initials else "", parts[full[0]][0]
    if not full:
        return "", parts[0][0][:1], ""
    first, last = parts[full[0]][0], parts[full[-1]][0]
    if not turned and first not in given and (last in given or (last not in given and words[full[0]].isupper() and len(full) == 2)):
        first, last = last, first
    return first, first[0], last


def is_company(name: str | None, local: str) -> bool:
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"\(.*?\)", " ", name or ""))]
    if local:
        return local in _ROLES
    return any(w in _COMPANY or w in _LEGAL for w in words[1:]) or (len(words) > 1 and words[0] in _COMPANY)


def company_words(name: str | None) -> list[str]:
    """The words of a company's name without legal forms, departments and order."""
    s = re.sub(r"\(.*?\)|\s[-–]\s.*$", " ", name or "")
    words = re.findall(r"[^\W\d_]+", re.sub(r"^([^,]+),\s*(.+)$", r"\2 \1", s))
    return [w for w in (fold(x) for x in words) if w not in _LEGAL]


def address_forms(g: str, s: str, nicks: list[str]) -> set[str]:
    """Local parts that a person's address may have."""
    firsts = {g, *nicks}
    return {f"{a}{x}{s}" for a in firsts for x in "._-"} | {f"{s}{x}{a}" for a in firsts for x in "._-"} | {f"{g[0]}{s}", f"{s}{g[0]}", f"{g[0]}.{s}", f"{g}{s}", s}


def likelihood(canon: tuple[str, str, str], seen: tuple[str, str, str, str, str], forms: set[str], fulls: list[str], given: bool) -> float:
    """How likely a person (given, surname, domain) is written as (given, initial, surname, local, domain).

    ``fulls`` are the names that the typed given name may stand for, ``given`` is whether it is a known one.
    """
    g, s, d = canon
    ng, ni, ns, local, dom = seen
    p = 1.0
    if ns:
        p *= 0.9 if ns == s else 0.03 if len(s) > 3 and one_edit(ns, s) else 1e-9
    if ng:
        nick = g in fulls
        p *= 0.5 if ng == g else 0.15 if nick else 0.02 if len(g) > 3 and one_edit(ng, g) else 0.004 if not given and len(ng) > 2 and (g[:3] == ng[:3] or g.endswith(ng)) else 1e-7
    elif ni:
        p *= 0.15 if ni == g[0] else 1e-6
    elif ns:
        p *= 0.02
    if local:
        if local in forms:
            p *= 0.9 if re.search(r"[._-]", local) else 0.15
        elif any(one_edit(local, f) for f in forms if abs(len(local) - len(f)) <= 1):
            p *= 0.02
        else:
            p *= 1e-7
        p *= 0.8 if dom == d else 0.05
    else:
        p *= 0.1
    return p


def _evidence(mentions: DataFrame) -> DataFrame:
    """(kind, word, other, surname): what single spellings tell about names, their address confirming the surname.

    ``given``: a word written before a surname, the address beginning with its letter. ``nick``: two words that stand for each
    other beside one surname, one in the name and the other in the address.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for name, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                local, _ = house(address)
                m = re.fullmatch(r"([^\W\d_]+)\s+(?:[^\W\d_]\.?\s+)?([^\W\d_]+)", name or "")
                if m and not name.isupper() and len(m[1]) > 2 and local.endswith(fold(m[2])) and local[:1] == fold(m[1])[:1]:
                    rows.add(("given", fold(m[1]), "", fold(m[2])))
                plain = re.sub(r"\(.*?\)|<.*?>|[\"'“”]", " ", name or "")
                words = [fold(w) for w in re.findall(r"[^\W\d_]+", plain) if len(w) > 1 and w.lower() not in _TITLES]
                parts = [x for x in re.split(r"[._-]", local) if x]
                if len(words) == 2 == len(parts) and local not in _ROLES:
                    for own, surname in (words, words[::-1]):
                        there = parts[1] if parts[0] == surname else parts[0] if parts[1] == surname else ""
                        if there and own not in parts and min(len(own), len(there)) > 2 and not one_edit(own, there):
                            rows.add(("nick", min(own, there), max(own, there), surname))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["kind", "word", "other", "surname"])

    return mentions.select("name_typed", "address").distinct().mapInArrow(read, "kind string, word string, other string, surname string").distinct()


def name_model(mentions: DataFrame) -> DataFrame:
    """(word, given, fulls, nicks): whether a folded word is a known given name, the names it may stand for, and those that may stand for it.

    A given name stands before at least MIN_SURNAMES surnames. Of two words that stand for each other the one that stands
    before more surnames is the name, else the longer one.
    """
    evidence = cut_lineage(_evidence(mentions))
    counted = evidence.where("kind = 'given'").groupBy("word").agg(F.countDistinct("surname").alias("n"))
    given = counted.where(F.col("n") >= MIN_SURNAMES).select("word")
    pairs = evidence.where("kind = 'nick'").groupBy("word", "other").agg(F.countDistinct("surname").alias("times"))
    pairs = pairs.join(counted.withColumnRenamed("n", "a"), "word", "left").join(counted.select(F.col("word").alias("other"), F.col("n").alias("b")), "other", "left")
    a, b = (F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.length(w).alias("l"), F.col(w).alias("w")) for n, w in (("a", "word"), ("b", "other")))
    pairs = pairs.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"), "times").select(F.col("x.w").alias("word"), F.col("y.w").alias("other"), "times")
    nicks = pairs.where(F.col("times") >= MIN_NICKNAMED).select("word", "other")
    none = F.lit(None).cast("string")
    rows = given.select("word", F.lit(True).alias("given"), none.alias("full"), none.alias("nick"))
    rows = rows.unionByName(nicks.select("word", F.lit(False).alias("given"), none.alias("full"), F.col("other").alias("nick")))
    rows = rows.unionByName(nicks.select(F.col("other").alias("word"), F.lit(False).alias("given"), F.col("word").alias("full"), none.alias("nick")))
    return rows.groupBy("word").agg(F.max("given").alias("given"), F.sort_array(F.collect_set("full")).alias("fulls"), F.sort_array(F.collect_set("nick")).alias("nicks"))


def _words_of(name: str | None, address: str | None) -> set[str]:
    """The folded words under which the model may know a spelling."""
    local, _ = house(address)
    return {fold(w) for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", name or "")} | {x for x in re.split(r"[._-]", local) if x}


def link(mentions: DataFrame) -> DataFrame:
    """(mention_id, entity) of ``mentions`` (mention_id, name_typed, address, n_seen)."""
    rows = mentions.where("mention_id is not null").select("mention_id", "name_typed", "address", F.coalesce("n_seen", F.lit(1)).alias("n_seen")).dropDuplicates(["mention_id"])
    # Distinct spellings are attributed once, whatever the number of mentions that share them.
    forms = rows.groupBy("name_typed", "address").agg(F.sum("n_seen").alias("n_seen"))
    model = cut_lineage(name_model(rows))
    near = broadcast_if(model, BROADCAST_MODEL)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_words_of(n, a)) for n, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.append_column("words", pa.array(found, pa.list_(pa.string())))

    asking = forms.mapInArrow(ask, "name_typed string, address string, n_seen bigint, words array<string>")
    told = asking.withColumn("word", F.explode_outer("words")).join(near, "word", "left")
    told = told.groupBy("name_typed", "address", "n_seen").agg(F.collect_list(F.when(F.col("given").isNotNull(), F.struct("word", "given", "fulls", "nicks"))).alias("model"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, address, n, model_ in zip(*(c.to_pylist() for c in batch.columns)):
                known = {m["word"] for m in model_ if m["given"]}
                full = {m["word"]: m["fulls"] for m in model_ if m["fulls"]}
                short = {m["word"]: m["nicks"] for m in model_}
                local, dom = house(address)
                if is_company(name, local):
                    words = company_words(name)
                    keys = {f"o:{dom}"} if dom else {f"w:{k}" for w in [*words, "".join(words)] for k in deletions(w) if w not in _COMPANY}
                    out.append((name, address, n, "org", "", "", " ".join(words), local, dom, False, sorted(keys), [], False))
                    continue
                g, i, s = read_name(name, known | full.keys())
                parts = [x for x in re.split(r"[._-]", local) if x]
                surnames = {s, *(parts if len(parts) > 1 else [local, local[1:], local[:-1]])} - {""}
                keys = {f"p:{k}" for x in surnames if len(x) > 2 for k in deletions(x)}
                typed, sure = g, False
                if g and s and local:
                    if g not in known and g in full:
                        g = next((f for f in full[g] if local in {f"{f}{x}{s}" for x in "._-"} | {f"{s}{x}{f}" for x in "._-"}), g)
                    # a typing error seldom stands in name and address alike, so a full agreement is enough for an unknown name
                    agree = {g, s} == set(parts) and g not in full
                    sure = ((g in known or bool(short.get(g))) and local in address_forms(g, s, short.get(g, []))) or agree
                elif not name and len(parts) == 2 and parts[0] in known:
                    g, i, s, sure = parts[0], parts[0][0], parts[1], True
                out.append((name, address, n, "person" if (name or local) else "none", g, i, s, local, dom, sure, sorted(keys), full.get(typed, []), typed in known))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    names = ["name_typed", "address", "n_seen", "kind", "given", "initial", "surname", "local", "dom", "sure", "keys", "fulls", "known"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
    parsed = told.mapInArrow(
        read, "name_typed string, address string, n_seen bigint, kind string, given string, initial string, surname string, local string, dom string, sure boolean, keys array<string>, fulls array<string>, known boolean"
    )

    # Written once: plans over kept tables hold all that made them, and each later plan would repeat it in the driver.
    parsed = cut_lineage(parsed)

    # Candidates: people whose name and address agree, ranked by frequency; and companies by domain.
    people = parsed.where("kind = 'person' and sure").groupBy("dom", "given", "surname").agg(F.sum("n_seen").alias("freq"))
    firm = F.when(F.col("kind") == "org", F.col("n_seen")).otherwise(0)
    houses = parsed.where("dom <> ''").groupBy("dom").agg(F.sum(firm).alias("freq"), F.max_by(F.when(F.col("kind") == "org", F.col("surname")), firm).alias("words"))
    canon_people = people.select(F.concat_ws("|", F.lit("P"), "dom", "given", "surname").alias("canon"), "freq", F.col("given").alias("cg"), F.col("surname").alias("cs"), F.col("dom").alias("cd"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [(f"p:{k}", *r) for r in zip(*(c.to_pylist() for c in batch.columns)) for k in deletions(r[3])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate([pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])], ["key", "canon", "freq", "cg", "cs", "cd"])

    def spread_houses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [(f"w:{k}", f"O|{d}", f, "", w or "", d) for d, f, w in zip(*(c.to_pylist() for c in batch.columns)) for x in [*(w or "").split(), d.split(".")[0]] if x not in _COMPANY for k in deletions(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate([pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])], ["key", "canon", "freq", "cg", "cs", "cd"])

    schema = "key string, canon string, freq bigint, cg string, cs string, cd string"
    candidates = canon_people.mapInArrow(spread, schema).unionByName(houses.select("dom", "freq", "words").mapInArrow(spread_houses, schema)).distinct()
    asked = parsed.where("not (kind = 'org' and dom <> '')").withColumn("key", F.explode("keys")).drop("keys", "sure", "n_seen")
    nicks = model.where(F.size("nicks") > 0).select(F.col("word").alias("cg"), F.col("nicks").alias("cn"))
    met = asked.join(candidates, "key").drop("key").distinct().join(broadcast_if(nicks, BROADCAST_MODEL), "cg", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[tuple[str, str], set[str]] = {}
        for batch in batches:
            p = []
            for _, _, kind, g, i, s, local, dom, canon, freq, cg, cs, cd, fulls, known, cn in zip(*(c.to_pylist() for c in batch.columns)):
                if canon[0] == "O":
                    a, b = s.split(), cs.split()
                    same = sum(1 for x in a if any(x == y or (len(x) > 3 and one_edit(x, y)) or (len(x) > 2 and y.startswith(x)) for y in b))
                    label = cd.split(".")[0]
                    joined = any(one_edit("".join(x), y) for x in (a, a[::-1]) for y in ("".join(b), label))
                    value = (0.5 if joined else 0.1 if a and same == len(a) else 0.0) if kind == "org" else 0.0
                elif kind == "person":
                    f = cache.get((cg, cs))
                    if f is None:
                        if len(cache) > 50_000:
                            cache.clear()
                        f = cache[cg, cs] = address_forms(cg, cs, cn or [])
                    value = likelihood((cg, cs, cd), (g, i, s, local, dom), f, fulls, known)
                else:
                    value = 0.0
                p.append(value if value >= MIN_LIKELIHOOD else 0.0)
            yield batch.select(["name_typed", "address", "canon"]).append_column("p", pa.array(p, pa.float64())).append_column("post", pa.array([x * math.log2(2 + f) for x, f in zip(p, batch.column(9).to_pylist())], pa.float64()))

    columns = ["name_typed", "address", "kind", "given", "initial", "surname", "local", "dom", "canon", "freq", "cg", "cs", "cd", "fulls", "known", "cn"]
    scored = met.select(*columns).mapInArrow(score, "name_typed string, address string, canon string, p double, post double").where("p > 0")

    # One person may write from several houses: candidates of one full name are one entity, named by the most frequent.
    full = canon_people.groupBy("cg", "cs").agg(F.max_by("canon", F.struct("freq", "canon")).alias("root"))
    roots = canon_people.join(full, ["cg", "cs"]).select("canon", "root")
    rooted = scored.join(roots, "canon", "left").withColumn("root", F.coalesce("root", "canon")).groupBy("name_typed", "address", "root").agg(F.max("post").alias("post"))
    best = rooted.groupBy("name_typed", "address").agg(F.max_by("root", F.struct("post", "root")).alias("root"), F.max("post").alias("top"), F.sum("post").alias("whole"))
    clear = best.where(F.col("whole") - F.col("top") <= F.col("top") / MIN_ODDS).select("name_typed", "address", "root")

    # what is not attached stays with its like: one house, surname and initial, else one address or spelling
    alike = (F.col("kind") == "person") & (F.col("surname") != "") & (F.col("initial") != "")
    alone = F.when(F.col("kind") == "none", F.lit(None)).when(alike, F.concat_ws("|", F.lit("U"), "dom", "surname", "initial")).otherwise(F.concat_ws("|", F.lit("U"), F.when(F.col("local") != "", F.concat("local", F.lit("@"), "dom")).otherwise(F.lower("name_typed"))))
    own = parsed.select("name_typed", "address", F.when((F.col("kind") == "org") & (F.col("dom") != ""), F.concat(F.lit("O|"), "dom")).otherwise(alone).alias("own"))
    keyed = lambda a, b: F.col(f"{a}.name_typed").eqNullSafe(F.col(f"{b}.name_typed")) & F.col(f"{a}.address").eqNullSafe(F.col(f"{b}.address"))
    entity = own.alias("o").join(clear.alias("c"), keyed("o", "c"), "left").select("o.name_typed", "o.address", F.coalesce("root", "own").alias("entity"))
    named = rows.alias("r").join(entity.alias("e"), keyed("r", "e"), "left")
    return named.select("mention_id", F.coalesce("entity", F.concat(F.lit("N|"), F.col("mention_id").cast("string"))).alias("entity"))


def linked_pairs(mentions: DataFrame) -> DataFrame:
    """(mention_a, mention_b): all pairs of mentions of one entity, mention_a < mention_b."""
    linked = cut_lineage(link(mentions))
    a = linked.select("entity", F.col("mention_id").alias("mention_a"))
    b = linked.select("entity", F.col("mention_id").alias("mention_b"))
    return a.join(b, "entity").where("mention_a < mention_b").select("mention_a", "mention_b")
