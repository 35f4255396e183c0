"""Texts that were cut off: by a field's limit or in mid-transfer.

The lengths at which texts of a source stop are read as discrete hazards: of
the texts that reach a length, how many end there. A length whose hazard
stands out against its neighbours, with the false discoveries over all tested
lengths controlled, is a limit. A text with an incomplete ending is cut: by
the limit if its length is one, in mid-transfer else. Endings that may be
either, and set lines and phrases that are complete elsewhere, count as
incomplete at a limit only or at none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.session import materialise

#: Lengths on each side that a length is compared with.
NEIGHBOURS = 50
#: Share of false ones allowed among the limits found.
FALSE_DISCOVERY = 0.01
#: Different texts that must hold a line, or an ending phrase, for it to be a
#: set one, and their least share: of the texts of one site (category and
#: product) for a line, of all texts for a phrase.
REPEATED_IN = 5
SHARE, PHRASE_SHARE = 0.002, 0.0005
#: Minimum hashes of a text, and how many equal ones make it a version of others.
SKETCH, SHARED = 8, 3
_WORDS = 6

# Signs that close a sentence, what may follow them, signs of a cut.
_TERMINAL = ".!?。！？؟۔।:："
_CLOSERS = "\"'*_)]}»”’›`"
_CUT_SIGN = re.compile(
    r"(?:…|\.{3,}|\[\s*(?:…|\.{3}|cut|truncated|more|continued)\s*\]|<\s*(?:truncated|cut)\s*>)\s*$",
    re.I,
)
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_NUMBER_LINE = re.compile(r"^\s*[-+]?\d[\d.,]*\s*$")
_DOTTED = re.compile(r"(?:^|[\s(])(\d+(?:\.\d+)+)\.$")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?:;。！？\n|]+")
_DIGITS = re.compile(r"\d+")
_rng = np.random.default_rng(20240308)
_A = _rng.integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SKETCH, dtype=np.uint64)
_KINDS = ("closed", "open", "sign", "maybe")


def _cells(line: str) -> int:
    return line.strip().strip("|").count("|")


def ending(text: str) -> tuple[str, str]:
    """(kind, last line) of a text that is not blank.

    closed: a finished sentence, list item, table row or command block.
    open: stops without a sign of an end. sign: stops with a sign that may
    stand for a cut. maybe: complete by its form, but at a limit more likely
    cut (a number after which digits or octets may be missing).
    """
    s = text.rstrip()
    lines = s.split("\n")
    last = lines[-1].rstrip()
    fences = sum(1 for x in lines if x.lstrip().startswith("```"))
    if last.strip() == "```":
        return ("closed" if fences % 2 == 0 else "open"), last
    if _CUT_SIGN.search(last):
        return "sign", last
    if fences % 2:
        return "open", last
    if last.lstrip().startswith("|"):
        before = lines[-2].strip() if len(lines) > 1 else ""
        whole = last.endswith("|") and len(last.strip()) > 1
        if whole and before.startswith("|"):
            whole = _cells(last) == _cells(before)
        return ("closed" if whole else "open"), last
    if re.match(r"^\s*#{1,6}(?:\s|$)", last):
        return "open", last
    if _NUMBER_LINE.match(last):
        before = lines[-2].strip() if len(lines) > 1 else ""
        listed = _NUMBER_LINE.match(before) or before.endswith(":")
        return ("maybe" if listed or last[-1] == "." else "open"), last
    if last.endswith(")"):
        return ("closed" if "(" in last else "open"), last
    core = last.rstrip(_CLOSERS).rstrip() or last
    if core[-1] in _TERMINAL:
        if core[-1] in ":：" and core != last:
            return "open", last
        if core[-1] in ":：":
            return "maybe", last
        dotted = _DOTTED.search(core)
        if dotted and core == last:
            parts = dotted[1].count(".") + 1
            if parts != 4:
                return ("open" if parts == 3 else "maybe"), last
        return "closed", last
    return "open", last


def _key(words: list[str]) -> int:
    h = xxhash.xxh64_intdigest(" ".join(words))
    return h - (1 << 64) if h >= 1 << 63 else h


def _plain(line: str, product: str | None) -> list[list[str]]:
    """The line's words, and its words with the document's product masked."""
    line = line.lower()
    out = [_LETTERS.findall(line)]
    name = product.strip().lower() if product else ""
    if name and name in line:
        out.append(re.findall(r"[^\W\d_]+|\u0001", line.replace(name, "\u0001")))
    return [x for x in out if len(x) >= _WORDS]


def _sketch(text: str) -> list[int]:
    """Minimum hashes of the sentences of all lines but the last, without digits.

    Versions of one text share most sentences; what differs in a few edits or
    in its numbers only still agrees in several of the minima.
    """
    s = text.rstrip()
    whole = _DIGITS.sub("", s[: s.rfind("\n") + 1] or s)
    held = {xxhash.xxh64_intdigest(x.strip()) for x in _SENTENCE.split(whole) if x.strip()}
    if not held:
        return [_key([s])] * SKETCH
    with np.errstate(over="ignore"):
        least = (np.array(list(held), np.uint64)[:, None] * _A + _B).min(0)
    return least.view(np.int64).tolist()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, rows = [], []
        texts, products = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for k, (text, product) in enumerate(zip(texts, products)):
            if text is None or not text.strip():
                continue
            kind, last = ending(text)
            tails, holes, phrase = [], set(), None
            for words in _plain(last, product):
                tails.append(_key(words))
                if kind != "closed":
                    # a cut shortens the last word, so that one is never left out,
                    # but its letters may stand in another order
                    holes |= {
                        _key([*words[:j], "\u0002", *words[j + 1 :]]) for j in range(len(words) - 1)
                    }
                    holes.add(_key([*words[:-1], "\u0003", *sorted(words[-1])]))
            if kind == "sign":
                phrase = _key(_LETTERS.findall(_CUT_SIGN.sub("", last).lower())[-3:])
            others = set()
            for line in text.rstrip().split("\n")[:-1]:
                others.update(map(_key, _plain(line, product)))
            keep.append(k)
            rows.append(
                (len(text), len(text.encode("utf-8", "surrogatepass")), kind, tails, list(holes), phrase, list(others), _key([text]), _sketch(text))
            )
        columns = list(zip(*rows)) or [[]] * 9
        at = pa.array(keep, pa.int32())
        longs = pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.string(), longs, longs, pa.int64(), longs, pa.int64(), longs)
        yield pa.RecordBatch.from_arrays(
            [batch.column(k).take(at) for k in range(3)]
            + [pa.array(c, t) for c, t in zip(columns, kinds)],
            ["doc_id", "source", "site", "chars", "bytes", "kind", "tails", "holes", "phrase", "lines", "same", "sketch"],
        )


def hazards(endings: DataFrame) -> DataFrame:
    """``(source, unit, length, texts, reached, expected, log_p)`` of every length.

    ``endings``: source, chars, bytes of each text. The hazard of a length is
    the share of the texts reaching it that end there. ``expected`` is what
    the hazard of the NEIGHBOURS lengths on each side, those at which no text
    ends included, gives for the texts that reach this length; ``log_p`` bounds
    the logarithm of the chance of as many ends as there are (Chernoff bound of
    the Poisson tail). A window sees the distinct lengths of one source.
    """
    cells = (
        endings.select(
            "source",
            F.explode(
                F.array(
                    F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
                    F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")),
                )
            ).alias("c"),
        )
        .groupBy("source", "c.unit", "c.length")
        .agg(F.count("*").alias("texts"))
    )
    by_length = W.partitionBy("source", "unit").orderBy("length")
    near = by_length.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    here_on = by_length.rangeBetween(0, W.unboundedFollowing)
    past = by_length.rangeBetween(NEIGHBOURS + 1, W.unboundedFollowing)
    length, texts = F.col("length"), F.col("texts")
    width = 2 * NEIGHBOURS + 1
    # how often texts pass the lengths of the window: those that end beyond it pass all
    passed = (
        F.coalesce(F.sum("texts").over(past), F.lit(0)) * width
        + F.sum(texts * length).over(near)
        - (length - NEIGHBOURS - 1) * F.sum("texts").over(near)
        - F.greatest(F.lit(NEIGHBOURS + 1) - length, F.lit(0)) * F.sum("texts").over(W.partitionBy("source", "unit"))
    )
    measured = cells.select(
        "source",
        "unit",
        "length",
        "texts",
        F.sum("texts").over(here_on).alias("reached"),
        (F.sum("texts").over(near) - texts).alias("near"),
        passed.alias("passed"),
    )
    risk = F.greatest(F.col("passed") - F.col("reached"), F.lit(1))
    mean = F.col("reached") * (F.col("near") + 1.0) / risk
    d = texts.cast("double")
    log_p = F.when(d > F.col("expected"), d - F.col("expected") - d * F.log(d / F.col("expected")))
    return (
        measured.withColumn("expected", mean)
        .withColumn("log_p", F.coalesce(log_p, F.lit(0.0)))
        .select("source", "unit", "length", "texts", "reached", "expected", "log_p")
    )


def limits(endings: DataFrame) -> DataFrame:
    """:func:`hazards` of the lengths that are limits.

    Limits are chosen by the Benjamini-Hochberg rule over all lengths of all
    sources, with a share of FALSE_DISCOVERY; its ranks come from a histogram
    of the p-values, which errs by less than a bin to the safe side.
    """
    tested = materialise(hazards(endings), "p8-cells")
    size = 0.25
    total = tested.agg(F.count("*").alias("m"))
    bins = (
        tested.groupBy(F.floor(F.col("log_p") / size).alias("bin"))
        .agg(F.count("*").alias("n"), F.max("log_p").alias("upper"))
        .withColumn("rank", F.sum("n").over(W.orderBy("bin")))
        .crossJoin(F.broadcast(total))
        .where(F.col("upper") <= F.log(F.lit(FALSE_DISCOVERY) * F.col("rank") / F.col("m")))
        .agg(F.max("upper").alias("most"))
    )
    return tested.crossJoin(F.broadcast(bins)).where(F.col("log_p") <= F.col("most")).drop("most")


def _set_ones(evidence: DataFrame, sketches: DataFrame, sites: DataFrame, share: float) -> DataFrame:
    """``key`` of what stands in REPEATED_IN different texts of a site and in
    ``share`` of its texts. ``evidence``: (site, key, same), ``sketches``: (same,
    sketch), which join only what stands often enough.

    Exact copies count once. A text that has SHARED minimum hashes in common
    with c texts of the same key counts 1 / c, so versions of one text count
    about once however many there are.
    """
    texts = evidence.dropDuplicates(["site", "key", "same"])
    often = (
        texts.groupBy("site", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= REPEATED_IN)
        .join(sites, "site")
        .where(F.col("n") >= share * F.col("total"))
        .select("site", "key")
    )
    places = materialise(
        texts.join(often, ["site", "key"])
        .join(sketches, "same")
        .select("site", "key", "same", F.posexplode("sketch").alias("p", "h")),
        "p8-places",
    )
    crowd = places.groupBy("site", "key", "p", "h").agg(F.count("*").alias("c"))
    crowded = F.sort_array(F.collect_list("c"), asc=False)[SHARED - 1]
    return (
        places.join(crowd, ["site", "key", "p", "h"])
        .groupBy("site", "key", "same")
        .agg((1.0 / crowded).alias("w"))
        .groupBy("site", "key")
        .agg(F.round(F.sum("w"), 6).alias("different"))
        .where(F.col("different") >= REPEATED_IN)
        .select("key")
        .distinct()
    )


def endings(documents: DataFrame) -> DataFrame:
    """What is read of every text that is not blank, as a written table."""
    named = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    found = documents.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.concat(named("category"), F.lit("\u0001"), named("product")).alias("site"),
        "text",
        "product",
    ).mapInArrow(
        _read,
        f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, site string, "
        "chars bigint, bytes bigint, kind string, tails array<bigint>, holes array<bigint>, "
        "phrase bigint, lines array<bigint>, same bigint, sketch array<bigint>",
    )
    return materialise(found, "p8-endings")


def judged(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, cut, at_limit)`` of every text that is not blank.

    Null, empty and blank texts are no cases and give no row; a null source is
    a source of its own; repeated rows are judged alike. An open ending is no
    cut if its line is a set one: it stands complete, that is inside a text or
    at the end of one at no limit, in many different texts of a site. Off the
    limits a line also counts as set if one word but the last differs from a
    set one, or the order of the last one's letters. A sign at the end is no
    cut if the phrase before it is a set one and the text does not end at a
    limit.
    """
    found = endings(documents)
    limit = materialise(
        limits(found).select("source", "unit", "length"), "p8-limits"
    )
    chars = limit.where("unit = 'chars'").select("source", F.col("length").alias("chars")).withColumn("lc", F.lit(True))
    octets = limit.where("unit = 'bytes'").select("source", F.col("length").alias("bytes")).withColumn("lb", F.lit(True))
    doubtful = found.where("kind <> 'closed'").drop("lines")
    sites = found.groupBy("site").agg(F.count_distinct("same").alias("total"))
    everywhere = found.select(F.lit("").alias("site"), "same").groupBy("site").agg(
        F.count_distinct("same").alias("total")
    )
    off_limits = found.drop("lines").join(chars, ["source", "chars"], "left_anti").join(
        octets, ["source", "bytes"], "left_anti"
    )
    tails = doubtful.select("doc_id", F.explode("tails").alias("key"))
    evidence = (
        found.select("site", "same", F.explode("lines").alias("key"))
        .unionByName(off_limits.where("kind <> 'sign'").select("site", "same", F.explode("tails").alias("key")))
        .join(tails.select("key").distinct(), "key", "left_semi")
    )
    sketches = found.select("same", "sketch").dropDuplicates(["same"])
    set_lines = materialise(_set_ones(evidence, sketches, sites, SHARE), "p8-lines")
    by_line = tails.join(set_lines, "key", "left_semi").select("doc_id").distinct()
    holes = doubtful.select("doc_id", F.explode("holes").alias("hole"))
    set_holes = holes.join(by_line, "doc_id", "left_semi").select("hole").distinct()
    by_hole = holes.join(set_holes, "hole", "left_semi").select("doc_id").distinct()
    phrases = doubtful.where("phrase is not null").select("doc_id", F.col("phrase").alias("key"))
    said = off_limits.where("phrase is not null").select(
        F.lit("").alias("site"), "same", F.col("phrase").alias("key")
    )
    by_phrase = phrases.join(_set_ones(said, sketches, everywhere, PHRASE_SHARE), "key", "left_semi").select("doc_id")
    set_line = by_line.withColumn("set_line", F.lit(True))
    like_one = by_hole.withColumn("like_one", F.lit(True))
    set_phrase = by_phrase.distinct().withColumn("set_phrase", F.lit(True))
    no = F.lit(False)
    at_limit = F.coalesce("lc", no) | F.coalesce("lb", no)
    is_set = F.coalesce("set_line", no) | (F.coalesce("like_one", no) & ~at_limit)
    cut = (
        F.when(F.col("kind") == "open", ~is_set)
        .when(F.col("kind") == "sign", at_limit | ~F.coalesce("set_phrase", no))
        .when(F.col("kind") == "maybe", at_limit & ~is_set)
        .otherwise(no)
    )
    # only doubtful endings can be cut; closed ones need no join but the limits
    seen = (
        found.select("doc_id", "source", "chars", "bytes", "kind")
        .join(chars, ["source", "chars"], "left")
        .join(octets, ["source", "bytes"], "left")
    )
    closed = seen.where("kind = 'closed'").select(
        "doc_id", "source", no.alias("cut"), at_limit.alias("at_limit")
    )
    rest = (
        seen.where("kind <> 'closed'")
        .join(set_line, "doc_id", "left")
        .join(like_one, "doc_id", "left")
        .join(set_phrase, "doc_id", "left")
        .select("doc_id", "source", cut.alias("cut"), at_limit.alias("at_limit"))
    )
    return closed.unionByName(rest)


def cut_documents(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that were cut."""
    return judged(documents).where("cut").select("doc_id").distinct()


def limit_report(documents: DataFrame) -> DataFrame:
    """``(source, unit, length, texts, reached, expected)`` of all limits."""
    return limits(endings(documents)).select(
        "source", "unit", "length", "texts", "reached", F.round("expected", 6).alias("expected")
    )


def source_report(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut ones, those cut at a limit and those cut in
    transfer, share of cut ones.

    Sources whose texts are all null or blank have no texts and no row.
    """
    return (
        judged(documents)
        .groupBy("source")
        .agg(
            F.count("*").alias("texts"),
            F.count_if("cut").alias("cut"),
            F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"),
            F.count_if(F.col("cut") & ~F.col("at_limit")).alias("cut_in_transfer"),
        )
        .withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
    )
