"""Main text of web pages by nearest-URL page differencing.

A page is read into lines, its block elements in order. Pages of a host are sorted by URL path, and each is paired with the neighbour
whose path shares the longer prefix; a longest common subsequence aligns the lines of the two, and shared lines are deleted. Pages in a
row that have the same content (the lines that can be main text) are one page here, so all of them get the same text. A neighbour that
shares nearly all lines the markup leaves open may be a copy with a change, so the other one is taken then; if both do, what all three
share is the template.

Differencing alone gives wrong results where menus and footers differ from page to page, which leaves nothing to delete, and where an
article quotes the same line as its neighbour. So markup corrects it line by line, on every page: a shared line stays if it stands in the
page's marked article (article, main); a line that no neighbour shares goes if it stands in a menu, header, footer, sidebar, notice,
advert, form or reader comments, told by element, role, class and id, or outside of an article that the page marks. Each row says how many lines
each of these rules decided.

The order of pages is dealt by split keys: RANGE_KEYS random keys a range place the splits, every key is dealt by them, and the first and last
of each range name the pages that both sides of a split must see. Pages then travel once, each range is one task, and a task holds three pages at a time
besides the ids of the copies of one page.

Defined cases: a null or empty page has an empty text; a null URL counts as host and path empty; repeated rows are copies of each other
and get the same text; a page alone in its host is only read; an empty table gives no rows. Only id, URL and html are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parts, small_batches

#: Bytes of html of one range (it is streamed, so they bound a task's time, not its memory), and keys drawn for each range to place its split.
RANGE_BYTES, RANGE_KEYS = 256 << 20, 32
#: The share of open lines in common from which a page may be a changed copy.
COPY = 0.9
#: Bits of the alignment table of two pages; larger pairs are halved.
ROOM = 1 << 26

# Quotes open a value only after an equals sign, as in `title=it's`; possessive, so that a tag is read once.
_REST = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|title|textarea|template|noscript|iframe|svg|math|select|object|audio|video|canvas)\b{_REST}>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_REST})(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Nouns that name boilerplate when they are the last word of a class or id, but for PLAIN ones: `post-comments`, `ad-slot`, not `social-policy`.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget widgets ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond reply replies discussion disqus related recommended recommendations pagination pager toolbar masthead topbar skip".split()
)
PLAIN = frozenset("area articles bar block body box button buttons container content count form group heading icons inner item items label link links list media news outer panel post posts section slot stories text thread title top trail unit wrap wrapper".split())
OUTER = frozenset("header legal copyright colophon imprint".split())  # marks only outside an article
NEGATED = frozenset("no not non has with without hide".split())
ARTICLE = frozenset(("article", "main"))
PROSE = frozenset("p h1 h2 h3".split())

OUT, OPEN, IN = 0, 1, 2


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate; inside: it stands in an article."""
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main") or (tag == "article" and not inside):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for word in (a or b or c).split():
                found = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower()) if x]
                if NEGATED.isdisjoint(found):
                    while found and found[-1] in PLAIN:
                        found.pop()
                    if found and (found[-1] in MARKS or (not inside and found[-1] in OUTER)):
                        return True
        elif (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def read_lines(page: str | None) -> tuple[list[str], list[int]]:
    """The blocks of a page in order, each OUT, OPEN or IN (of a marked article).

    A form goes, but one that holds the article, or most of the page's text in paragraphs, only wraps the page.
    """
    lines: list[str] = []
    kinds: list[int] = []
    owners: list[tuple[int, ...]] = []  # the forms a line stands in
    forms: list[list] = []  # [holds an article, paragraphs]
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # (tag, in boilerplate, in article, forms)
    held: list[str] = []
    page = page or ""
    empty = ("", False, False, ())

    def end() -> None:
        if held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                _, out, inside, around = stack[-1] if stack else empty
                lines.append(line)
                kinds.append(OUT if out else IN if inside else OPEN)
                owners.append(around)

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            held.append(html.unescape(page[at : token.start()]))
        at = token.end()
        tag = token.group(3)
        if tag is None:
            continue
        tag, closes = tag.lower(), token.group(2)
        if tag == "br":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        end()
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if stack and stack[-1][0] == "p" or stack and stack[-1][0] == tag and tag in ("li", "dt", "dd", "option"):
                stack.pop()
            if tag == "body":
                stack.clear()
            _, out, inside, around = stack[-1] if stack else empty
            out = out or _marked(tag, token.group(4) or "", inside)
            if tag == "form":
                around = (*around, len(forms))
                forms.append([False, 0])
            if not out:
                for form in around:
                    forms[form][0] |= tag in ARTICLE
                    forms[form][1] += tag in PROSE
            stack.append((tag, out, inside or tag in ARTICLE, around))
    if at < len(page):
        held.append(html.unescape(page[at:]))
    end()
    if forms:
        size = [len(x) if k != OUT else 0 for x, k in zip(lines, kinds, strict=True)]
        for form, (article, prose) in enumerate(forms):
            mine = sum(n for n, around in zip(size, owners, strict=True) if form in around)
            if not (article or (prose > 1 and 2 * mine > sum(size))):
                kinds = [OUT if form in around else k for k, around in zip(kinds, owners, strict=True)]
    return lines, kinds


def _rows(one: list, two: list) -> Iterator[int]:
    """Rows of the table of longest common subsequences as bit vectors: a bit is 0 where a prefix of `two` gains a line on the one before."""
    where: dict = {}
    for j, x in enumerate(two):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(two)) - 1
    v = full
    yield v
    for x in one:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _sizes(one: list, two: list) -> np.ndarray:
    """Lengths of the longest common subsequences of `one` with each prefix of `two`."""
    for last in _rows(one, two):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(two) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(two)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(one: list, two: list) -> list[int]:
    if len(one) * len(two) > ROOM and len(one) > 1:
        half = len(one) // 2
        cut = int((_sizes(one[:half], two) + _sizes(one[half:][::-1], two[::-1])[::-1]).argmax())
        return _aligned(one[:half], two[:cut]) + [half + i for i in _aligned(one[half:], two[cut:])]
    rows, out, i, j = list(_rows(one, two)), [], len(one), len(two)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def common_lines(one: list, two: list) -> list[int]:
    """Places in `one` of a longest common subsequence with `two`. Memory is linear in the lines: large tables are halved."""
    both = set(one) & set(two)
    places = [i for i, x in enumerate(one) if x in both]
    return [places[i] for i in _aligned([one[i] for i in places], [x for x in two if x in both])]


def fates(kinds: list[int], shared: set[int]) -> list[str]:
    """What becomes of each line: `shared` goes by differencing, `marked` by markup alone; `protected` is shared and stays, `own` stays."""
    article = IN in kinds
    out = []
    for i, kind in enumerate(kinds):
        stays = kind == (IN if article else OPEN)
        if i in shared:
            out.append("protected" if kind == IN else "shared")
        else:
            out.append("own" if stays else "marked")
    return out


STAY = ("own", "protected")


def main_text(lines: list[str], kinds: list[int], shared: set[int]) -> str:
    return "\n".join(x for x, fate in zip(lines, fates(kinds, shared), strict=True) if fate in STAY)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def content(lines: list[str], kinds: list[int]) -> int:
    """Hash of the lines that can be main text; pages of one content are copies."""
    kind = IN if IN in kinds else OPEN
    return xxhash.xxh64_intdigest("\n".join(x for x, k in zip(lines, kinds, strict=True) if k == kind).encode(errors="replace"), kind) - 2**63


def shared_with_nearest(lines: list, kinds: list, around: list[tuple[int, list, list]]) -> set[int]:
    """Lines shared with the nearest of the neighbours (prefix, lines, kinds) that isn't nearly the same in open lines, else with all if there are two; ties go to the first."""
    opened = {i for i, kind in enumerate(kinds) if kind == OPEN}
    found = []
    for _, other, other_kinds in sorted(around, key=lambda x: -x[0]):
        found.append(set(common_lines(lines, other)))
        if len(found[-1] & opened) < COPY * max(len(opened), list(other_kinds).count(OPEN)):
            return found[-1]
    return found[0] & found[1] if len(found) == 2 else set()


def _host_path(url_col: str):
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/]*", 0))
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", ""), F.regexp_replace(bare, r"^[^/]*", "")


class _Run:
    """Copies in a row: their lines, and the paths at which the run begins and ends."""

    def __init__(self, mark: tuple, path: str, lines: list[str], kinds: list[int]):
        self.mark, self.first, self.last, self.lines, self.kinds = mark, path, path, lines, kinds
        self.copies: list[tuple] = []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, and its numbers of lines that went as `shared` and as `marked`, and stayed as `protected` and `own`."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    host, path = _host_path(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    key = ["host", "path", F.coalesce("page_id", F.lit(-1)).alias("no"), F.xxhash64("url", "html").alias("mix")]
    names = ["host", "path", "no", "mix"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [content(*read_lines(x.as_py())) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found, pa.int64())], [*names, "size", "content"])

    marked = rows.select(*key, F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"), "html").mapInArrow(mark, "host string, path string, no long, mix long, size long, content long")
    keys = Scratch(spark).save(marked, "keys")
    n, size = keys.agg(F.count("*"), F.sum("size")).first()
    ranges = max(8 * parts(spark), -(-(size or 0) // RANGE_BYTES))
    share = RANGE_KEYS * ranges / max(n, 1)
    drawn = keys.select(*names) if share >= 1 else keys.select(*names).sample(share, 7)
    places = sorted(tuple(r) for r in drawn.collect())
    bounds = sorted({places[i * len(places) // ranges] for i in range(1, ranges)}) if places else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect_right(bounds, key) for key in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*keys_names, "range"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first run of copies of a range its ends and the page after it, of the last run the page before it and its ends."""
        out = run = old = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = run is not None and (row[0], row[4]) == (run[0], run[4])
                if not same:
                    if out is not None and len(out) == 1:
                        out += [old, row]
                    out, run, before = out or [row], row, old
                old = row
        if out is not None:
            out = [*(out if len(out) == 3 else [out[0], old, None]), before, run, old]
            yield pa.RecordBatch.from_pylist([dict(zip(keys_names, x or (None,) * 5, strict=True)) | {"at": i} for i, x in enumerate(out)], schema=ends_schema)

    # RANGE_KEYS + 6 rows a range reach the driver, whatever the number of pages.
    keys_names = [*names, "content"]
    ends_schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("no", pa.int64()), ("mix", pa.int64()), ("content", pa.int64()), ("at", pa.int32())])
    dealt_keys = keys.select(*keys_names).mapInArrow(deal, "host string, path string, no long, mix long, content long, range int")
    ordered = dealt_keys.repartitionById(ranges, "range").sortWithinPartitions(*names).select(*keys_names).mapInArrow(ends, "host string, path string, no long, mix long, content long, at int")
    got = sorted((r["range"], r["at"], tuple(r)[:5]) for r in ordered.withColumn("range", F.spark_partition_id()).collect() if r["host"] is not None)
    held: dict[int, dict[int, tuple]] = {}
    for part, at, row in got:
        held.setdefault(part, {})[at] = row
    edge = sorted(held.values(), key=lambda x: x[0][:4])
    splits = [x[0][:4] for x in edge[1:]]  # the first key of every range but the first
    ghosts: dict[tuple, list[int]] = {}
    #: For each range the path at which its first run begins, and its last one ends.
    reach: list[list[str]] = [[x[0][1], x[5][1]] for x in edge]
    for i, mine in enumerate(edge):
        for side, step, last, begin, beyond in ((0, -1, 5, 4, 3), (1, 1, 0, 1, 2)):
            own, j = mine[0 if side == 0 else 5], i + step
            while 0 <= j < len(edge):
                other = edge[j]
                found = other[last]
                if (found[0], found[4]) == (own[0], own[4]):
                    reach[i][side] = other[begin][1]
                    if (found := other.get(beyond)) is None:
                        j += step
                        continue
                ghosts.setdefault(found[:4], []).append(i)
                break

    fields = "bucket int, page_id long, url string, host string, path string, no long, mix long, ghost boolean, content long, lines array<string>, kinds array<tinyint>"
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, host, path, page, no, mix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, kinds = read_lines(page)
                here, at = (host, path, no, mix), bisect_right(splits, (host, path, no, mix))
                rest = (content(lines, kinds), lines, kinds)
                out.append((at, page_id, url, *here, False, *rest))
                out += [(g, page_id, url, *here, True, *rest) for g in dict.fromkeys(ghosts.get(here, ())) if g != at]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    counted = ["shared", "marked", "protected", "own"]
    out_types = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.int64()] * len(counted)]
    out_names = ["page_id", "url", "text", "n_chars", *(f"n_{x}" for x in counted)]

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of a range in order: a run of copies is done when the next one has been read."""
        before = run = None
        first = True

        def done(after: _Run | None, bucket: int) -> list[tuple]:
            nonlocal first
            if run is None or run.mark[2]:
                return []
            low = reach[bucket][0] if first else run.first
            high = reach[bucket][1] if after is None or after.mark[2] else run.last
            first = False
            around = [(_prefix(p, x.last if x is before else x.first), x.lines, x.kinds) for x, p in ((before, low), (after, high)) if x is not None and x.mark[0] == run.mark[0]]
            fate = fates(run.kinds, shared_with_nearest(run.lines, run.kinds, around))
            text = "\n".join(x for x, f in zip(run.lines, fate, strict=True) if f in STAY)
            numbers = [fate.count(x) for x in counted]
            return [(*copy, text, len(text), *numbers) for copy in run.copies]

        def table(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256], strict=True), out_types, strict=True)], out_names)

        bucket = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*batch.columns, strict=True):
                at, page_id, url, host, path, _, _, ghost, mark_ = (x.as_py() for x in row[:9])
                if at != bucket:
                    out += done(None, bucket)
                    before, run, first, bucket = None, None, True, at
                if run is None or run.mark != (host, mark_, ghost):
                    new = _Run((host, mark_, ghost), path, row[9].as_py(), row[10].as_py())
                    out += done(new, bucket)
                    before, run = run, new
                run.last = path
                run.copies.append((page_id, url))
            yield from table(out)
        yield from table(done(None, bucket))

    tagged = rows.select("page_id", "url", "host", "path", "html", *key[2:]).mapInArrow(read, fields)
    dealt = tagged.repartitionById(ranges, "bucket").sortWithinPartitions("bucket", *names)
    return dealt.mapInArrow(difference, ", ".join(["page_id long, url string, text string, n_chars long", *(f"{x} long" for x in out_names[4:])]))
