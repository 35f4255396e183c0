"""Repair of text taken from scanned pages.

Running headers and footers are lines at page edges that repeat, letter pairs
or edit distance permitting some misread ones: the document's title, a line of
several chunks of one document, or of several documents of one source. Page
numbers are numbers at a line of their own that fit into the increasing
sequence of the document's pages. Words divided at line ends are found by the
vocabulary of the whole corpus, misread ones by confusions that are learned
from it: what rare words have in the place of a frequent word's letters, where
it shows evenly over many frequent words. Repair drops the first two, joins
the third, corrects the fourth and gives continuous paragraphs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.llm.common import leaf_chunks
from corpusmill.llm.site_lines import source_name
from corpusmill.session import materialise

#: How much more often the printed word must stand than the misread one.
RATIO, RATIO_ODD = 20, 2
#: Most frequent words of letters only that confusions are learned from.
LEARN_FROM = 5_000
#: A confusion shows in EVEN of the places where its rate lets it be expected,
#: in PLACES of those of the most widespread one, and within RATE of the usual rate.
EVEN, PLACES, RATE = 0.4, 0.02, 5
#: Similarity (shared letter pairs) from which a line repeats the title.
LIKE_TITLE = 0.7
#: Chunks of one document that hold a line at a page edge for it to be running,
#: or documents of one source, and their least share of those with page edges.
IN_CHUNKS, IN_DOCUMENTS, SHARE = 3, 5, 0.1
#: Share of a running line's letters that may differ.
DIFFER = 0.3
#: Chunks of a document whose pages are compared in one window.
SPAN = 1024
#: Most frequent words sent to the workers; others are joined.
COMMON = 50_000
#: Distinct words counted in a worker before their counts are passed on.
FLUSH = 300_000
DIVISION = "-‐‑¬­"
_TRIM = ".,;:!?()[]{}`*\"<>|~«»„“”’‘'=+_/\\"
_PIECE = re.compile(r"[-/‐‑]")
_ODD = re.compile(r"[^\W\d_][^\w'\-][^\W\d_]|[^\W\d_]\d[^\W\d_]|^\d[^\W\d_]{2}|[^\W\d_]{2}\d$|[¢@ﬀ-ﬆ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIVIDED = re.compile(rf"([^\W\d_]+(?:[-'][^\W\d_]+)*)([{DIVISION}])\s*$")
_GOES_ON = re.compile(r"^\s*([^\W\d_]+(?:[-'][^\W\d_]+)*)")
_PAGE = re.compile(
    r"^(?P<a>\s*[-–—~*·•=\[(<|#]*\s*)(?P<w>(?:page|seite|página|pagina|pág\.?|pag\.?|p\.|s\.)?)\s*"
    r"(?P<n>\d{1,5})\s*(?:(?:/|\||of|von|de|sur)\s*\d{1,5})?(?P<z>\s*[-–—~*·•=\])>|#]*\s*)$",
    re.I,
)
_NUMBER = re.compile(r"^\s*\d[\d.,]*\s*$")
_CHAPTER = re.compile(r"\b(?:chapter|kapitel|chapitre|capítulo|page|seite)\s+\d+\b", re.I)


def _letters(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def _pairs(text: str) -> Counter:
    return Counter(text[k : k + 2] for k in range(len(text) - 1))


class Layout:
    """Kinds of the lines of one chunk: code, table, header, page_number or text."""

    def __init__(self, text: str, title: str, first: int | None, last: int | None):
        self.lines = text.split("\n")
        self.kinds = ["text"] * len(self.lines)
        self.numbers: dict[int, int] = {}
        plain = _letters(title)
        pairs, size = _pairs(plain), len(plain)
        named = [w for w in plain.split() if len(w) > 2]
        # a line with few of the title's words cannot share that many of its letter pairs
        least = 0.35 * len(named)
        fence = False
        for k, line in enumerate(self.lines):
            bare = line.strip()
            if bare.startswith("```"):
                fence = not fence
                self.kinds[k] = "code"
            elif fence:
                self.kinds[k] = "code"
            elif not bare:
                self.kinds[k] = "blank"
            elif bare.startswith("|"):
                self.kinds[k] = "table"
            elif self._is_page(k, first, last):
                self.kinds[k] = "page_number"
            elif size >= 4 and 0.6 * size <= len(bare) <= 2 * size + 24 and bare[0] != "#":
                lower = bare.lower()
                if sum(w in lower for w in named) < least:
                    continue
                own = _letters(_CHAPTER.sub(" ", line))
                if 0.7 * size <= len(own) <= 1.4 * size:
                    common = sum((_pairs(own) & pairs).values())
                    if 2 * common >= LIKE_TITLE * (len(own) + size - 2):
                        self.kinds[k] = "header"
        if first is not None and last is not None:
            self._in_sequence()

    def _in_sequence(self) -> None:
        """Of the chunk's page numbers, only those of its longest rising sequence."""
        at = [k for k, kind in enumerate(self.kinds) if kind == "page_number"]
        if len(at) < 2:
            return
        ends: list[int] = []  # least last number of a sequence of each length
        length = []
        for k in at:
            n = self.numbers[k]
            x = bisect_left(ends, n + 1)
            ends[x:] = [n, *ends[x + 1 :]]
            length.append(x + 1)
        want, above = len(ends), float("inf")
        for k, x in zip(reversed(at), reversed(length)):
            if x == want and self.numbers[k] <= above:
                want, above = want - 1, self.numbers[k]
            else:
                self.kinds[k] = "text"

    def _is_page(self, k: int, first: int | None, last: int | None) -> bool:
        line = self.lines[k]
        m = _PAGE.match(line)
        if not m:
            return False
        n = int(m["n"])
        decorated = bool(m["w"] or m["a"].strip() or m["z"].strip()) or len(m["a"]) >= 3
        if first is not None and n < first - 1 or last is not None and n > last + 1:
            return False
        self.numbers[k] = n
        if decorated:
            return True
        # a bare number: not one of a list of numbers, and not the end of a sentence
        around = [x for x in (k - 1, k + 1) if 0 <= x < len(self.lines)]
        if any(_NUMBER.match(self.lines[x]) for x in around):
            return False
        before = next((self.lines[x].strip() for x in range(k - 1, -1, -1) if self.lines[x].strip()), "")
        return 0 < k < len(self.lines) - 1 and not before.endswith(":")

    def edges(self) -> Iterator[tuple[int, str]]:
        """(line, its letters) of text lines at a page's edge: next to a page
        number or a header, or breaking into a sentence."""
        held = [k for k, kind in enumerate(self.kinds) if kind != "blank"]
        for before, k, after in zip(held, held[1:], held[2:]):
            if self.kinds[k] != "text":
                continue
            around = {self.kinds[before], self.kinds[after]}
            if around.isdisjoint(("page_number", "header")):
                if around != {"text"} or not (before < k - 1 and after > k + 1):
                    continue
                ends, goes_on = self.lines[before].rstrip()[-1], self.lines[after].lstrip()[0]
                if not (ends.isalnum() or ends in f",{DIVISION}") or not goes_on.islower():
                    continue
            letters = _letters(self.lines[k])
            if len(letters) >= 4:
                yield k, letters

    def divided(self) -> list[tuple[int, int, str, str, str]]:
        """(line, next line, first part, mark, second part) of words that a
        line's end divides; layout lines and blank ones between are skipped."""
        out = []
        for k, line in enumerate(self.lines):
            if self.kinds[k] != "text" or line.rstrip()[-1:] not in DIVISION:
                continue
            m = _DIVIDED.search(line)
            if not m:
                continue
            j = k + 1
            while j < len(self.lines) and self.kinds[j] in ("blank", "page_number", "header"):
                j += 1
            if j == len(self.lines) or self.kinds[j] != "text":
                continue
            rest = _GOES_ON.match(self.lines[j])
            if rest and rest[1][0].islower():
                out.append((k, j, m[1], m[2], rest[1]))
        return out

    def tokens(self, divided: list) -> Iterator[tuple[int, list[str]]]:
        """(line, its tokens) of running text, without parts of words that a
        line's end or the end of the text may have cut."""
        after = {j for _, j, *_ in divided}
        end = len(self.lines) - 1
        for k, line in enumerate(self.lines):
            if self.kinds[k] != "text":
                continue
            tokens = line.split()
            if k in after:
                tokens = tokens[1:]
            if tokens and tokens[-1][-1] in DIVISION:
                tokens = tokens[:-1]
            if k == end and tokens and tokens[-1][-1].isalnum():
                tokens = tokens[:-1]
            yield k, tokens


def words_of(token: str) -> tuple[str, ...]:
    """The words of a token, in lower case; none of one that was cut short."""
    if token.endswith(("…", "...")):
        return ()
    return tuple(
        word
        for word in _PIECE.split(token.strip(_TRIM).lower())
        if len(word) >= 3 and any(c.isalpha() for c in word)
    )


def printed_forms(word: str, confusions: list[tuple[str, str]]) -> Iterator[str]:
    """What ``word`` may have been before one misrecognition."""
    for printed, seen in confusions:
        at = word.find(seen)
        while at >= 0:
            yield word[:at] + printed + word[at + len(seen) :]
            at = word.find(seen, at + 1)


def _pieces(word: str) -> Iterator[tuple[int, str]]:
    """Every one or two consecutive characters, with their place."""
    for size in (1, 2):
        for at in range(len(word) - size + 1):
            yield at, word[at : at + size]


def _shown(frequent: Mapping[str, int]):
    """Where words of the vocabulary differ from a frequent one in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[str, str], list] = defaultdict(list)
        for w, m in frequent.items():
            for at, printed in _pieces(w):
                open_[w[:at], w[at + len(printed) :]].append((w, printed, m))
        for batch in batches:
            rows = []
            for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at, seen in _pieces(x):
                    for w, printed, m in open_.get((x[:at], x[at + len(seen) :]), ()):
                        # two for two, and what adds or drops a letter, are typing slips
                        both = len(seen) + len(printed)
                        if both > 3 or m < RATIO * n or seen in printed or printed in seen:
                            continue
                        rows.append((printed, seen, w, at, n))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["printed", "seen", "word", "place", "n"]
            )

    return run


def confusions(vocabulary: DataFrame) -> list[tuple[str, str]]:
    """(printed, seen): what recognition makes of one or two letters.

    ``vocabulary``: word, n, of the whole corpus. Recognition misreads a letter
    at much the same rate wherever it stands, so a confusion shows in about as
    many places of the frequent words as that rate makes likely; what sets two
    words apart by chance or by grammar shows in few places, however often.
    Collected are LEARN_FROM words and a table of pairs of the alphabet.
    """
    top = (
        vocabulary.where(F.expr(r"word rlike '^\\p{L}+$'"))
        .orderBy(F.desc("n"), "word")
        .limit(LEARN_FROM)
    )
    frequent = {r["word"]: r["n"] for r in top.collect()}
    places: dict[str, list[int]] = defaultdict(list)
    for w, m in frequent.items():
        for _, printed in _pieces(w):
            if m >= RATIO:
                places[printed].append(m)
    shown = (
        vocabulary.mapInArrow(
            _shown(frequent), "printed string, seen string, word string, place int, n bigint"
        )
        .groupBy("printed", "seen", "word", "place")
        .agg(F.sum("n").alias("n"))
        .groupBy("printed", "seen")
        .agg(F.count("*").alias("places"), F.sum("n").alias("n"))
    )
    most = shown.agg(F.max("places").alias("most"))
    # one place proves nothing where others show in ten
    least = F.greatest(F.col("most") * PLACES, F.least(F.lit(2.0), F.col("most") / 5))
    rows = shown.crossJoin(F.broadcast(most)).where(F.col("places") >= least).collect()
    even = []
    for r in rows:
        rate = r["n"] / sum(places[r["printed"]])
        likely = sum(1 - math.exp(-rate * m) for m in places[r["printed"]])
        if r["places"] >= EVEN * likely:
            even.append((rate, r["places"], r["printed"], r["seen"]))
    even.sort(reverse=True)
    usual, seen_at = 0.0, 0
    for rate, count, *_ in even:
        seen_at += count
        usual = rate
        if 2 * seen_at >= sum(e[1] for e in even):
            break
    # what is no letter needs less: it has no place inside a word
    least = lambda seen: usual / RATE * (1 if seen.isalpha() else 0.25)
    return sorted((p, s) for rate, _, p, s in even if least(s) <= rate <= usual * RATE)


def _title(content: str | None, raw: str | None) -> str:
    """The document title, from the prefix of the chunk's content."""
    if not content or raw is None or not content.endswith(raw):
        return ""
    return content[: len(content) - len(raw)].strip().rsplit(" > ", 1)[0]


def _layouts(batch: pa.RecordBatch) -> Iterator[tuple[int, Layout]]:
    columns = [batch.column(c).to_pylist() for c in range(5)]
    for id_, raw, title, first, last in zip(*columns):
        if raw:
            yield id_, Layout(raw, title or "", first, last)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter = Counter()

    def out() -> pa.RecordBatch:
        counts: Counter = Counter()
        for token, n in tokens.items():
            for word in words_of(token):
                counts[word] += n
        words = pa.array(list(counts), pa.string())
        return pa.RecordBatch.from_arrays(
            [words, pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for _, layout in _layouts(batch):
            for _, found in layout.tokens(layout.divided()):
                tokens.update(found)
            if len(tokens) > FLUSH:
                yield out()
                tokens.clear()
    if tokens:
        yield out()


def _forms(known: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                odd = bool(_ODD.search(word))
                once = set(printed_forms(word, known))
                forms = {(c, 1) for c in once}
                if odd:  # a second misread letter only where the first is beyond doubt
                    forms |= {(c, 2) for f in once for c in printed_forms(f, known) if c not in once}
                rows.extend((word, n, odd, c, step) for c, step in forms if len(c) >= 2)
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "odd", "printed", "step"]
            )

    return run


def _bands(letters: str) -> list[int]:
    """Keys of which lines with most letter triples in common share one."""
    triples = {letters[k : k + 3] for k in range(max(1, len(letters) - 2))}
    out = []
    for band in range(6):
        least = [min(xxhash.xxh32_intdigest(t, 2 * band + k) for t in triples) for k in (0, 1)]
        out.append((least[0] << 31) ^ least[1] ^ band)
    return out


class Defects:
    """Defects of all leaf chunks.

    Null and empty texts have none; a chunk without title prefix has only
    headers that repeat elsewhere; where pages are null, page numbers must fit
    between those of the chunks before and after; re-delivered chunks count
    once; an empty table gives none. The vocabulary counts every word of every
    leaf chunk. What is sent to the workers is at most COMMON words; words
    beyond these are joined. Without ``documents`` (id, category, product)
    running lines are sought within each document only.
    """

    def __init__(self, chunks: DataFrame, documents: DataFrame | None = None):
        narrow = chunks.where("chunk_kind = 'leaf' and id is not null")
        if "created_at" not in narrow.columns:
            narrow = narrow.withColumn("created_at", F.lit(None).cast("timestamp"))
        head = F.when(
            F.endswith("content", "raw_content"),
            F.expr("substring(content, 1, length(content) - length(raw_content))"),
        )
        title = F.regexp_extract(head, r"(?s)^\s*(.*?)(?: > (?:(?! > ).)*)?\s*$", 1)
        narrow = narrow.withColumn("title", F.coalesce(title, F.lit("")))
        self.leaves = materialise(
            leaf_chunks(
                narrow, "raw_content", "title", "page_start", "page_end", "document_id", "chunk_index"
            ),
            "p1-leaves",
        )
        self.documents = documents
        self.vocabulary = materialise(
            self.leaves.mapInArrow(_count, "word string, n bigint")
            .groupBy("word")
            .agg(F.sum("n").alias("n")),
            "p1-vocabulary",
        )
        self.misread = materialise(self._misread(), "p1-misread")
        self.lines = materialise(self._lines(), "p1-lines")
        self.layout = materialise(self._layout(), "p1-layout")

    def _misread(self) -> DataFrame:
        """``(word, printed)`` of the words that are misread forms."""
        forms = self.vocabulary.mapInArrow(
            _forms(confusions(self.vocabulary)),
            "word string, n bigint, odd boolean, printed string, step int",
        )
        known = self.vocabulary.select(F.col("word").alias("printed"), F.col("n").alias("m"))
        plain = ~F.col("odd") & (F.col("m") >= F.col("n") * RATIO)
        shown = F.col("odd") & (F.col("m") >= F.col("n") * RATIO_ODD)
        best = F.max_by("printed", F.struct(-F.col("step"), F.col("m"), "printed"))
        return (
            forms.join(known, "printed")
            .where(plain | shown)
            .groupBy("word")
            .agg(best.alias("printed"))
        )

    def _layout(self) -> DataFrame:
        """``(id, line_no, kind)`` of headers, footers and page numbers."""
        titles = self.lines.where("kind = 'header'").select("id", "line_no", "kind")
        return titles.unionByName(self._page_numbers()).unionByName(self._running())

    def _page_numbers(self) -> DataFrame:
        """Numbers that fit into the sequence of their document's pages.

        Chunks with both pages known were judged by these. Else the pages of
        the nearest chunks before and after bound the number, and of its
        neighbours among the numbers one at least must be in order with it. Windows run over SPAN chunks
        and over one row for each SPAN, never over a whole long document.
        """
        rows = self.lines.where("kind = 'page_number'").select("id", "line_no", "kind", "n")
        place = self.leaves.select("id", "document_id", "chunk_index", "page_start", "page_end")
        unsure = place.where("page_start is null or page_end is null").select("id", "document_id")
        known = rows.join(unsure.select("id"), "id", "left_anti").select("id", "line_no", "kind")
        asked = rows.join(unsure, "id").select("document_id").distinct()
        near = place.join(asked, "document_id", "left_semi").withColumn(
            "span", F.floor(F.coalesce("chunk_index", F.lit(0)) / SPAN)
        )
        own = W.partitionBy("document_id", "span").orderBy("chunk_index", "id")
        before = own.rowsBetween(W.unboundedPreceding, -1)
        after = own.rowsBetween(1, W.unboundedFollowing)
        first, last = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
        spans = near.groupBy("document_id", "span").agg(F.max(first).alias("low"), F.min(last).alias("high"))
        order = W.partitionBy("document_id").orderBy("span")
        spans = spans.select(
            "document_id",
            "span",
            F.max("low").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("span_low"),
            F.min("high").over(order.rowsBetween(1, W.unboundedFollowing)).alias("span_high"),
        )
        bounds = (
            near.withColumns({"low": F.max(first).over(before), "high": F.min(last).over(after)})
            .join(spans, ["document_id", "span"])
            .select(
                "id",
                "document_id",
                "span",
                "chunk_index",
                F.coalesce("page_start", "low", "span_low").alias("low"),
                F.coalesce("page_end", "high", "span_high").alias("high"),
            )
        )
        order = W.partitionBy("document_id", "span").orderBy("chunk_index", "id", "line_no")
        rising = F.coalesce(F.lag("n").over(order) <= F.col("n"), F.lit(True)) | F.coalesce(
            F.lead("n").over(order) >= F.col("n"), F.lit(True)
        )
        fits = F.coalesce(F.col("n") >= F.col("low") - 1, F.lit(True)) & F.coalesce(
            F.col("n") <= F.col("high") + 1, F.lit(True)
        )
        placed = rows.join(unsure.select("id"), "id").join(bounds, "id")
        placed = placed.where(fits).withColumn("rising", rising).where("rising")
        alone = rows.join(unsure.where("document_id is null").select("id"), "id")
        return known.unionByName(placed.select("id", "line_no", "kind")).unionByName(
            alone.select("id", "line_no", "kind")
        )

    def _running(self) -> DataFrame:
        """Lines at page edges that repeat in a document or a source.

        Lines with a band of letter triples in common are counted together and
        each is compared with one of them, so a group is never gathered.
        """
        at = self.lines.where("kind = 'edge'").select("id", "line_no", F.col("word").alias("letters"), "bands")
        place = self.leaves.select("id", "document_id").where("document_id is not null")
        at = materialise(at.join(place, "id"), "p1-edges")
        found = self._repeated(
            at.withColumns({"scope": F.col("document_id"), "member": F.col("id").cast("string")}),
            lambda members: members >= IN_CHUNKS,
        )
        if self.documents is not None:
            sources = (
                self.documents.select(
                    F.col("id").alias("document_id"),
                    source_name(F.col("category"), F.col("product")).alias("scope"),
                )
                .where("document_id is not null and scope is not null")
                .groupBy("document_id")
                .agg(F.min("scope").alias("scope"))
            )
            of = at.join(sources, "document_id").withColumn("member", F.col("document_id"))
            total = of.groupBy("scope").agg(F.count_distinct("member").alias("total"))
            enough = lambda m: (m >= IN_DOCUMENTS) & (m >= SHARE * F.col("total"))
            found = found.unionByName(self._repeated(of.join(total, "scope"), enough))
        return found.distinct().withColumn("kind", F.lit("header"))

    @staticmethod
    def _repeated(at: DataFrame, enough) -> DataFrame:
        """``(id, line_no)``; ``at`` also has scope, member, letters and bands."""
        total = ["total"] if "total" in at.columns else []
        keyed = at.select("scope", *total, "member", "id", "line_no", "letters", F.explode("bands").alias("band"))
        group = ["scope", *total, "band"]
        lead = (
            keyed.groupBy(*group)
            .agg(F.min("letters").alias("lead"), F.count_distinct("member").alias("members"))
            .where(enough(F.col("members")))
            .drop("members")
        )
        most = (F.greatest(F.length("letters"), F.length("lead")) * DIFFER).cast("int")
        alike = keyed.join(lead, group).where(F.levenshtein("letters", "lead") <= most)
        alike = alike.select("scope", *total, "lead", "member", "id", "line_no").distinct()
        counted = (
            alike.groupBy("scope", *total, "lead")
            .agg(F.count_distinct("member").alias("members"))
            .where(enough(F.col("members")))
            .select("scope", "lead")
        )
        return alike.join(counted, ["scope", "lead"]).select("id", "line_no")

    def _lines(self) -> DataFrame:
        """Defects that the layout shows, and candidates for the others."""
        top = (
            self.vocabulary.orderBy(F.desc("n"), "word")
            .limit(COMMON)
            .join(self.misread, "word", "left_anti")
        )
        common = self.leaves.sparkSession.sparkContext.broadcast(
            frozenset(r[0] for r in top.select("word").collect())  # at most COMMON words
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = common.value
            memo: dict[str, tuple[str, ...]] = {}  # of a token, the words that are not known
            for batch in batches:
                rows = []
                if len(memo) > FLUSH:
                    memo.clear()
                for id_, layout in _layouts(batch):
                    for k, kind in enumerate(layout.kinds):
                        if kind in ("header", "page_number"):
                            rows.append((id_, k + 1, kind, None, None, None, None, None, layout.numbers.get(k), None))
                    for k, letters in layout.edges():
                        rows.append((id_, k + 1, "edge", letters, None, None, None, None, None, _bands(letters)))
                    divided = layout.divided()
                    for k, j, a, mark, b in divided:
                        a_last, b_first = _PIECE.split(a)[-1].lower(), _PIECE.split(b)[0].lower()
                        rows.append(
                            (id_, k + 1, "divided", a_last + b_first, a_last, b_first, mark, j + 1, None, None)
                        )
                    for k, tokens in layout.tokens(divided):
                        unknown = set()
                        for token in tokens:
                            rare = memo.get(token)
                            if rare is None:
                                rare = tuple(w for w in words_of(token) if w not in known)
                                memo[token] = rare
                            if rare:
                                unknown.update(rare)
                        for w in unknown:
                            rows.append((id_, k + 1, "word", w, None, None, None, None, None, None))
                columns = list(zip(*rows)) or [[]] * 10
                kinds = [pa.int64(), pa.int32(), *[pa.string()] * 5, pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["id", "line_no", "kind", "word", "a", "b", "mark", "next_no", "n", "bands"],
                )

        return self.leaves.mapInArrow(
            run,
            "id bigint, line_no int, kind string, word string, a string, b string, mark string, "
            "next_no int, n bigint, bands array<bigint>",
        )

    def divided(self) -> DataFrame:
        """``(id, line_no, next_no, mark)`` of words divided at a line's end.

        The joined word must stand in the corpus more often than the compound
        with a hyphen; if neither stands there, a plain hyphen counts as
        division unless both parts are words of their own.
        """
        rows = self.lines.where("kind = 'divided'").select("id", "line_no", "next_no", "mark", "word", "a", "b")
        asked = rows.select(
            F.explode(
                F.array("word", "a", "b", F.concat("a", F.lit("\u0000"), "b"))
            ).alias("word")
        ).distinct()
        single = self.vocabulary.join(asked, "word", "left_semi")
        n = lambda name: single.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
        compounds = self._compounds(rows)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        known = (
            rows.join(n("word"), "word", "left")
            .join(n("a"), "a", "left")
            .join(n("b"), "b", "left")
            .join(compounds, ["a", "b"], "left")
            .join(self.misread.select("word", F.lit(True).alias("bad")), "word", "left")
        )
        joined, compound = zero("n_word"), zero("n_compound")
        both = (zero("n_a") > 0) & (zero("n_b") > 0)
        neither = (joined == 0) & (compound == 0)
        yes = F.when(F.coalesce("bad", F.lit(False)), True).otherwise(
            F.when(neither, (F.col("mark") != "-") | ~both).otherwise(joined > compound)
        )
        return known.where(yes).select("id", "line_no", "next_no", "mark")

    def _compounds(self, rows: DataFrame) -> DataFrame:
        """How often the candidates stand as hyphenated compounds in a line."""
        pairs = rows.select("a", "b").distinct()
        token = F.explode(
            F.regexp_extract_all(F.lower("raw_content"), F.lit(r"\p{L}+(?:-\p{L}+)+"), 0)
        )
        found = (
            self.leaves.where(F.col("raw_content").contains("-"))
            .select(token.alias("t"))
            .groupBy("t")
            .agg(F.count("*").alias("n"))
            .withColumn("p", F.split("t", "-"))
            .select(
                F.explode(
                    F.transform(
                        F.sequence(F.lit(1), F.size("p") - 1),
                        lambda k: F.struct(
                            F.element_at("p", k).alias("a"), F.element_at("p", k + 1).alias("b")
                        ),
                    )
                ).alias("c"),
                "n",
            )
            .groupBy("c.a", "c.b")
            .agg(F.sum("n").alias("n_compound"))
        )
        return found.join(pairs, ["a", "b"], "left_semi")

    def words(self) -> DataFrame:
        """``(id, line_no, word, printed)`` of misread words."""
        return (
            self.lines.where("kind = 'word'")
            .select("id", "line_no", "word")
            .join(self.misread, "word")
            .join(self.layout.where("kind = 'header'"), ["id", "line_no"], "left_anti")
        )

    def found(self) -> DataFrame:
        return (
            self.layout.select("id", "line_no", F.col("kind").alias("defect"))
            .unionByName(self.divided().select("id", "line_no", F.lit("hyphen").alias("defect")))
            .unionByName(self.words().select("id", "line_no", F.lit("misread").alias("defect")))
            .distinct()
        )


def defects(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(id, line_no, defect)``, line_no from 1, blank lines counted."""
    return Defects(chunks, documents).found()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    structure = re.compile(r"^\s*(?:[-*+•]|\d+[.)]|#{1,6})\s|^\s*(?:\||```)")
    for batch in batches:
        out = []
        for raw, dropped, joined, fixes in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4))):
            if raw is None:
                out.append(None)
                continue
            lines = raw.split("\n")
            for fix in fixes or []:
                k = fix["line_no"] - 1
                if k < len(lines):
                    lines[k] = _replace(lines[k], fix["word"], fix["printed"])
            gone = {n - 1 for n in dropped or []}
            glued = {n - 1 for n in joined or []}
            paragraphs: list[str] = []
            now, fence, glue, between = "", False, False, False
            for k, line in enumerate(lines):
                if k in gone:
                    between = True  # a page edge: blank lines around it end nothing
                    continue
                bare = line.strip()
                if fence or bare.startswith("```"):
                    if not fence and now:
                        paragraphs.append(now)
                        now = ""
                    now = f"{now}\n{line}" if now else line
                    if bare.startswith("```"):
                        fence = not fence
                        if not fence:
                            paragraphs.append(now)
                            now = ""
                    continue
                if not bare:
                    edge = between or (k + 1) in gone
                    if now and not glue and not (edge and now[-1] not in ".!?:。"):
                        paragraphs.append(now)
                        now = ""
                    continue
                between = False
                if structure.match(line) and now and not glue:
                    paragraphs.append(now)
                    now = ""
                text = line.rstrip()
                if not now:
                    now = text
                elif glue:
                    now += text.lstrip()
                elif structure.match(now.rsplit("\n", 1)[-1]) and now.lstrip().startswith("|"):
                    now += "\n" + text
                elif now[-1] == "-" and len(now) > 1 and now[-2].isalpha():
                    now += text.lstrip()
                else:
                    now += " " + text.lstrip()
                glue = k in glued
                if glue:
                    now = now[:-1]
            if now:
                paragraphs.append(now)
            out.append("\n\n".join(paragraphs))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string())], ["id", "text"]
        )


def _replace(line: str, word: str, printed: str) -> str:
    """Every occurrence of a misread word, with the case it has there."""

    def put(m: re.Match) -> str:
        seen = m[0]
        if seen.isupper() and len(seen) > 1:
            return printed.upper()
        return printed.capitalize() if seen[0].isupper() else printed

    return re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", put, line, flags=re.I)


def repaired(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``(id, text, defects)`` of every leaf chunk, in continuous paragraphs.

    Lists, tables and command blocks keep their lines' order; a null text
    stays null.
    """
    found = Defects(chunks, documents)
    per_id = lambda df, value, name: df.groupBy("id").agg(F.collect_set(value).alias(name))
    dropped = per_id(found.layout, "line_no", "dropped")
    joined = per_id(found.divided(), "line_no", "joined")
    fixes = per_id(found.words(), F.struct("line_no", "word", "printed"), "fixes")
    all_of = (
        found.leaves.select("id", "raw_content")
        .join(dropped, "id", "left")
        .join(joined, "id", "left")
        .join(fixes, "id", "left")
    )
    sized = lambda c: F.coalesce(F.size(c), F.lit(0))
    counted = all_of.select(
        "id", (sized("dropped") + sized("joined") + sized("fixes")).alias("defects")
    )
    texts = all_of.select("id", "raw_content", "dropped", "joined", "fixes").mapInArrow(
        _repaired, "id bigint, text string"
    )
    return texts.join(counted, "id")
