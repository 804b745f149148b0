"""Problem 1: mixed timestamp texts to one UTC instant.

Every text is parsed under each format that it is valid for (named months, year-month-day, month-day-year,
day-month-year, seconds, milli-, micro- or nanoseconds since 1970). A source's formats are taken as a
mixture: values contribute likelihood under each of their valid parses, expectation-maximisation over the
per-source counts of candidate sets gives the weights, and the posterior of each candidate set chooses the
interpretation or marks it as ambiguous. A source's declared day-month order enters as a likelihood: a reading
against it is ``AGAINST`` times as likely as one that agrees, and a value that only such readings fit may also be
mistyped. So both readings of 02/03/99 survive to the mixture, and the source's own counts and declaration decide.

The zone is an explicit offset, else a zone name, else zone letters, else the source's own zone. A local time
that never happened or happened twice in its zone is not resolved.

Defined results: null, empty and unreadable texts have status ``unreadable``; dates without a time of day
``no_time``; zone-less times of an unknown source ``no_zone``; local times in a gap or an overlap ``gap`` and
``overlap``; bare counts that lie in no unit within ``COUNT_YEARS`` ``no_unit``; values that fit their source's
declared order in no way ``mistyped``; candidate sets without a clear posterior ``ambiguous``. Of rows that repeat an id the first
arrival counts; null ids are left out; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.runtime import broadcast_if

#: Sources of at most so many rows are sent to every executor.
BROADCAST_SOURCES = 100_000
#: A candidate is chosen if its posterior is at least this.
MIN_POSTERIOR = 0.95
EM_ROUNDS = 50
#: The likelihood of a reading against the source's declared order.
AGAINST = 1e-4
#: The reading of a value that fits its source's declared order in no way.
MISTYPED = "mistyped"
#: Years that a bare count since 1970 may lie in, which decides its unit.
COUNT_YEARS = (1990, 2037)
#: The years that two-digit years belong to.
SHORT_YEARS = range(1999, 2004)

#: Zone letters and their minutes east of UTC, as used at the archive's sites.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "sgt": 480, "sst": 480, "hkt": 480, "jst": 540, "kst": 540,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Month names by their number, in the languages of the archive's clients.
MONTHS = {
    1: "jan january januar enero ene janvier janv jänner", 2: "feb february februar febrero février févr fevrier", 3: "mar march märz mär mrz maerz marzo mars",
    4: "apr april abril abr avril avr", 5: "may mai mayo", 6: "jun june juni junio juin", 7: "jul july juli julio juillet juil",
    8: "aug august agosto ago août aout", 9: "sep sept september septiembre septembre", 10: "oct october oktober okt octubre octobre",
    11: "nov november noviembre novembre", 12: "dec december dezember dez diciembre dic décembre déc decembre",
}
_MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}

_TIME = re.compile(r"(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?![\d:])(?:\s*([ap])\.?m\.?(?![a-z]))?")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?")
_OFFSET = re.compile(r"^(?:gmt|utc)?\s*([+-])(\d{1,2}):?(\d{2})(?!\d)")
_NUMERIC = re.compile(r"^(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})$")
_DAY_FIRST = re.compile(r"^(\d{1,2})(?:st|nd|rd|th)?[. -]*(?:de )?([^\W\d_]{3,})[. -]*,?(?:de )?\s*'?(\d{4}|\d{2})$")
_MONTH_FIRST = re.compile(r"^([^\W\d_]{3,})\.?[ -]*(\d{1,2})(?:st|nd|rd|th)?[ ,-]+'?(\d{4}|\d{2})$")
_YEAR_NAMED = re.compile(r"^(\d{4})[ -]+([^\W\d_]{3,})\.?[ -]+(\d{1,2})$")
_UNITS = (("count_s", 1_000_000, 1), ("count_ms", 1_000, 1), ("count_us", 1, 1), ("count_ns", 1, 1_000))
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MICRO = timedelta(microseconds=1)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=4096)
def _zone_any_case(name: str) -> ZoneInfo | None:
    """A zone by its name in any case, as ``Area/City_Part``."""
    return _zone(name) or _zone("/".join("_".join(w.capitalize() for w in part.split("_")) for part in name.split("/")))


def _year(text: str) -> int | None:
    n = int(text)
    if len(text) == 4:
        return n
    return next((y for y in SHORT_YEARS if y % 100 == n), None) if len(text) == 2 else None


def _dates(text: str, order: str | None) -> list[tuple[str, int, int, int]]:
    """(format, year, month, day) of each valid reading of the date part; ``order`` is the source's declared one."""
    found: list[tuple[str, int | None, int | None, int]] = []
    if m := _NUMERIC.match(text):
        a, _, b, c = m.groups()
        if len(a) == 4:
            found.append(("ymd", int(a), int(b), int(c)))
        elif len(a) <= 2 and len(c) in (2, 4):
            if order != "dmy":
                found.append(("mdy", _year(c), int(a), int(b)))
            if order != "mdy":
                found.append(("dmy", _year(c), int(b), int(a)))
            if len(a) == 2 and len(c) == 2 and int(a) > 31:
                found.append(("ymd", _year(a), int(b), int(c)))
    elif m := _DAY_FIRST.match(text):
        found.append(("named", _year(m[3]), _MONTH.get(m[2]), int(m[1])))
    elif m := _MONTH_FIRST.match(text):
        found.append(("named", _year(m[3]), _MONTH.get(m[1]), int(m[2])))
    elif m := _YEAR_NAMED.match(text):
        found.append(("named", int(m[1]), _MONTH.get(m[2]), int(m[3])))
    valid = []
    for name, y, mo, d in found:
        try:
            datetime(y or 0, mo or 0, d)
        except ValueError:
            continue
        valid.append((name, y, mo, d))
    return valid


def _offset_minutes(rest: str) -> int | ZoneInfo | str | None:
    """Minutes of an explicit offset or of zone letters, or a zone, or None without any; "unknown" for unreadable letters."""
    rest = rest.strip(" ,;")
    if not rest:
        return None
    if m := _OFFSET.match(rest):
        minutes = int(m[2]) * 60 + int(m[3])
        return minutes if m[1] == "+" else -minutes
    if m := re.match(r"^\[?([a-z_]+(?:/[a-z_+-]+)+)\]?$", rest):
        return _zone_any_case(m[1]) or "unknown"
    if m := re.match(r"^\(?([a-z]{1,5})\.?\)?(?:\s*\([^)]*\))?$", rest):
        return ZONE_MINUTES.get(m[1], "unknown")
    return "unknown"


def readings(text: str | None, order: str | None, site: str | None) -> tuple[str, list[tuple[str, int]]]:
    """Status, and (format, microseconds since 1970 UTC) of each valid reading of ``text``."""
    s = " ".join((text or "").lower().split())
    if not s:
        return "unreadable", []
    if s.isascii() and s.isdigit() and len(s) <= 22:
        n, out = int(s), []
        for name, times, parts in _UNITS:
            us = n * times // parts
            if us < 4e15 and COUNT_YEARS[0] <= (_EPOCH + us * _MICRO).year <= COUNT_YEARS[1]:
                out.append((name, us))
        # a count that is early or late in every unit has no clear one
        return ("read" if out else "no_unit"), out
    if m := _COMPACT.match(s):
        hour, minute, second, fraction, half = m[4], m[5], m[6], m[7], None
        date, rest = f"{m[1]}-{m[2]}-{m[3]}", s[m.end() :]
    elif m := _TIME.search(s):
        hour, minute, second, fraction, half = m.groups()
        date, rest = s[: m.start()], s[m.end() :]
        if not date.strip(" ,t") and rest:  # time before date
            return "unreadable", []
    else:
        date = re.sub(r"^[^\W\d_]+\.?,\s*", "", s)
        return ("no_time" if _dates(date.strip(" ,"), None) else "unreadable"), []
    h, mi, sec = int(hour), int(minute), int(second or 0)
    if half:
        if not 1 <= h <= 12:
            return "unreadable", []
        h = h % 12 + (12 if half == "p" else 0)
    if h > 23 or mi > 59 or sec > 59:
        return "unreadable", []
    us = int(((fraction or "") + "000000")[:6])
    date = date.strip(" ,")
    if date.endswith("t"):
        date = date[:-1]
    weekday = re.match(r"^([^\W\d_]+)\.?,?\s+(?=.)", date)
    if weekday and weekday[1] not in _MONTH:
        date = date[weekday.end() :]
    dates = _dates(date.strip(" ,"), order)
    if not dates:
        return "unreadable", []
    zone = _offset_minutes(rest)
    if zone == "unknown":
        return "unreadable", []
    if zone is None:
        zone = _zone(site) if site else None
        if zone is None:
            return "no_zone", []
    out, why = [], "unreadable"
    for name, y, mo, d in dates:
        local = datetime(y, mo, d, h, mi, sec, us)
        if isinstance(zone, int):
            out.append((name, (local.replace(tzinfo=timezone.utc) - _EPOCH) // _MICRO - zone * 60_000_000))
            continue
        early, late = local.replace(tzinfo=zone).utcoffset(), local.replace(tzinfo=zone, fold=1).utcoffset()
        if early != late:
            why = "overlap" if early > late else "gap"
            continue
        out.append((name, (local - early - datetime(1970, 1, 1)) // _MICRO))
    return ("read" if out else why), out


def mixture(counts: pd.DataFrame) -> pd.DataFrame:
    """Expectation-maximisation for one source: columns source, date_order, formats (joined by a space), n -> source, formats, choice, posterior."""
    sets = [f.split(" ") for f in counts["formats"]]
    n = counts["n"].astype(float).tolist()
    declared = counts["date_order"].iloc[0]
    names = sorted({f for s in sets for f in s})
    fits = {f: AGAINST if declared in ("mdy", "dmy") and f in ("mdy", "dmy") and f != declared else 1.0 for f in names}
    weight = dict.fromkeys(names, 1.0 / len(names))
    for _ in range(EM_ROUNDS):
        mass = dict.fromkeys(names, 1e-9)
        for formats, k in zip(sets, n):
            total = sum(weight[f] * fits[f] for f in formats)
            for f in formats:
                mass[f] += k * weight[f] * fits[f] / total
        whole = sum(mass.values())
        weight = {f: m / whole for f, m in mass.items()}
    best = [max(formats, key=lambda f: (weight[f] * fits[f], f)) for formats in sets]
    posterior = [weight[b] * fits[b] / sum(weight[f] * fits[f] for f in formats) for b, formats in zip(best, sets)]
    return pd.DataFrame({"source": counts["source"].astype(object), "formats": counts["formats"].astype(object), "choice": pd.Series(best, dtype=object), "posterior": posterior})


def normalise(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, status, format, utc_us, posterior): one row per distinct id of ``rows`` (id, date_text, source, arrival).

    ``sources`` (source, zone, date_order) tells where a source writes; ``utc_us`` is null unless status is ``resolved``.
    """
    first = rows.where("id is not null").groupBy("id").agg(F.min_by(F.struct("date_text", "source"), "arrival").alias("r")).select("id", "r.date_text", "r.source")
    known = broadcast_if(sources.where("source is not null").groupBy("source").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order")), BROADCAST_SOURCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, from_, zones, orders = (batch.column(i) for i in range(5))
            status, formats, values = [], [], []
            for text, zone, order in zip(texts.to_pylist(), zones.to_pylist(), orders.to_pylist()):
                what, found = readings(text, None, zone)
                by_value: dict[int | None, str] = {}
                # readings that agree on the instant are one, under the declared order if that is among them
                for name, us in sorted(found, key=lambda x: x[0] != order):
                    by_value.setdefault(us, name)
                if order in ("mdy", "dmy") and found and all(name in ("mdy", "dmy") and name != order for name in by_value.values()):
                    by_value[None] = MISTYPED
                status.append(what)
                formats.append(" ".join(by_value.values()))
                values.append(list(by_value))
            yield pa.RecordBatch.from_arrays([ids, from_, pa.array(status), pa.array(formats), pa.array(values, pa.list_(pa.int64())), orders], ["id", "source", "status", "formats", "instants", "date_order"])

    read = first.join(known, "source", "left").select("id", "date_text", "source", "zone", "date_order").mapInArrow(run, "id string, source string, status string, formats string, instants array<bigint>, date_order string").persist()
    # The mixture is fitted on counts per source and candidate set, so a hot source is a few rows here.
    counts = read.where("status = 'read'").groupBy("source", "formats").agg(F.first("date_order").alias("date_order"), F.count(F.lit(1)).alias("n"))
    fitted = counts.groupBy("source").applyInPandas(mixture, "source string, formats string, choice string, posterior double")
    many = fitted.where(F.col("formats").contains(" ")).alias("m")
    joined = read.alias("r").join(many, F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.formats") == F.col("m.formats")), "left")
    single = F.size("r.instants") == 1
    clear = single | (F.col("posterior") >= MIN_POSTERIOR)
    at = F.array_position(F.split("r.formats", " "), F.coalesce("choice", F.col("r.formats"))).cast("int")
    chosen = F.coalesce("choice", F.col("r.formats"))
    ok = (F.col("status") == "read") & clear & (chosen != MISTYPED)
    return joined.select(
        "id",
        F.when(ok, "resolved").when((F.col("status") == "read") & clear, MISTYPED).when(F.col("status") == "read", "ambiguous").otherwise(F.col("status")).alias("status"),
        F.when(ok, F.coalesce("choice", F.col("r.formats"))).alias("format"),
        F.when(ok, F.get("r.instants", at - 1)).alias("utc_us"),
        F.when(single, F.lit(1.0)).otherwise(F.col("posterior")).alias("posterior"),
    )
