"""Main text of web pages by differencing each page with its nearest page by URL.

Pages are range-partitioned and sorted by (host, path), so pages with near urls are neighbours however many
pages a host has. Each page becomes a list of lines (one for each block of its layout; scripts, styles, markup and named
boilerplate such as menus, forms, adverts or reader comments give none). Consecutive pages of a host
with exactly the same lines are a run of copies, however long. A page is paired with the nearest page of its host that differs: the end of the
run before its own or the start of the run after it, whichever has the longer common path prefix (of equal ones the run before). The lines of both
are aligned by their longest common subsequence, and shared lines are deleted. The cuts between partitions are
chosen first, over a small table of the pages' digests; the runs beside each cut are handed to its partitions as hashes of their lines,
so the text does not depend on how the pages are partitioned.

What a page itself marks as its article (``article``, ``main``, or a role or class that says so) is exempt from
deletion, as copies of an article share all its lines; and a page with such a mark keeps nothing else. Boilerplate is named by whole
words of a class, id or role, or by hyphenated ones that put it among words for places and parts (:func:`names_boilerplate`), also on an ``article``. A tag around a ``main``, or around the only articles of a page, drops nothing;
articles that lie in named boilerplate are kept if there are no others, but don't mark the page. A page
without lines teaches nothing and is passed over.

Defined results: a null or empty html gives an empty text; a page without a host, or alone on it, loses no line;
repeated rows are each other's copies; the columns ``text`` and ``n_chars`` replace those of the same name, others pass.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import pickle
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meshframes.llm.common import stored
from meshframes.llm.url_filter import host_and_path

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags without main text: what no article can lie in, what may wrap one, and what names boilerplate.
UNSEEN = frozenset("canvas datalist head iframe script select style svg template textarea title".split())
WRAPS = frozenset("button form input noscript object".split())
DROPPED = frozenset("aside footer menu nav".split())
#: Tags that are dropped outside an article only.
LOOSE = frozenset("dialog header label".split())
#: Whole words of a class, id or role that name boilerplate.
NAMED = frozenset(
    "ad ads advert advertisement adverts alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Parts of a hyphenated word that may stand before, or behind, one that names boilerplate.
BEFORE = frozenset("article blog bottom entry global home js left main mobile page post primary right secondary site story sub top user web wp".split())
BEHIND = frozenset(
    "area articles bar block body bottom box button buttons container content cta feed form frame group header heading holder icon icons inner item items link links list message module "
    "outer overlay panel post posts region row section slot stories strip tabs thread title top unit wall wrap wrapper zone".split()
)
ARTICLE = frozenset("article main".split())
MAIN_WORDS = frozenset("mainbody maincontent".split())
ARTICLE_WORDS = MAIN_WORDS | {"articlebody"}


@functools.lru_cache(100_000)
def names_boilerplate(word: str) -> bool:
    """True for a word of a class, id or role that names boilerplate as a whole, or as ``site-footer``, ``comment-list`` and ``cookie-banner`` do; not
    for ``share-price`` or ``has-sidebar``."""
    if word in NAMED:
        return True
    parts = [x for x in re.split("[-_]+", word) if x]
    i = next((i for i, x in enumerate(parts) if x not in BEFORE), len(parts))
    return len(parts) > 1 and i < len(parts) and parts[i] in NAMED and all(x in BEHIND or x in NAMED for x in parts[i + 1 :])


class PageLines(HTMLParser):
    """Lines of a page as (text, is it in the main article). Which dropped tags hold an article is known at the end only."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.read: list[tuple[list[tuple[str, tuple]], tuple]] = []  # parts of a line, the articles that it is in
        self.open: list[tuple[str, tuple, tuple, bool]] = []  # tag; drops and articles around it; is it unseen
        self.parts: list[tuple[str, tuple]] = []  # text, the drops that it is in
        self.drops: tuple[int, ...] = ()
        self.articles: tuple[int, ...] = ()
        self.unseen = 0
        self.names: list[bool] = []  # of each drop: does it name boilerplate, or is it something that may wrap a page
        self.found: list[tuple[bool, tuple]] = []  # of each article: is it a main, the drops around it

    def flush(self) -> None:
        if self.parts:
            self.read.append((self.parts, self.articles))
            self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append((" ", ()))
        if tag in ("body", "article", "main"):  # an unclosed head ends here
            self.close_to("head")
        if tag in VOID:
            return
        named = {k: (v or "").lower() for k, v in attrs if k in ("class", "id", "role", "itemprop", "hidden", "aria-hidden")}
        words = " ".join(named.get(k, "") for k in ("class", "id", "role")).split()
        joined = {x.replace("-", "").replace("_", "") for k in ("class", "id", "itemprop") for x in named.get(k, "").split()}
        main = tag == "main" or named.get("role") == "main" or bool(joined & MAIN_WORDS)
        article = main or tag in ARTICLE or named.get("role") in ARTICLE or bool(joined & ARTICLE_WORDS)
        unseen = tag in UNSEEN or "hidden" in named
        names = tag in DROPPED or (tag in LOOSE and not self.articles) or (tag not in ("html", "body") and not main and any(map(names_boilerplate, words)))
        self.open.append((tag, self.drops, self.articles, unseen))
        self.unseen += unseen
        if names or tag in WRAPS or named.get("aria-hidden") == "true":
            self.names.append(names)
            self.drops += (len(self.names) - 1,)
        if article and not names and not self.unseen:
            self.articles += (len(self.found),)
            self.found.append((main, self.drops))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_to(self, tag: str) -> None:
        if any(x[0] == tag for x in self.open):
            while True:
                t, self.drops, self.articles, unseen = self.open.pop()
                self.unseen -= unseen
                if t == tag:
                    break

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.close_to(tag)

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append((data, self.drops))

    def lines(self) -> list[tuple[str, bool]]:
        marks = {i for i, (main, drops) in enumerate(self.found) if main or not any(self.names[d] for d in drops)}
        held = {d for i, (_, drops) in enumerate(self.found) if i in marks or not marks for d in drops}
        out = []
        for parts, articles in self.read:
            line = " ".join("".join(x for x, drops in parts if held.issuperset(drops)).split())
            if line:
                out.append((line, not marks.isdisjoint(articles)))
        return out


def page_lines(html: str) -> list[tuple[str, bool]]:
    p = PageLines()
    p.feed(html)
    p.close()
    p.flush()
    return p.lines()


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt and Szymanski's algorithm)."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    tops: list[tuple] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect.bisect_left(ends, j)
            link = (i, tops[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tops.append(link)
            elif j < ends[k]:
                ends[k], tops[k] = j, link
    out: set[int] = set()
    link = tops[-1] if tops else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _kept(lines: list[tuple[str, bool]], shared: set[int]) -> str:
    marked = any(inside for _, inside in lines)
    return "\n".join(x for i, (x, inside) in enumerate(lines) if inside or not marked and i not in shared)


def main_text(lines: list[tuple[str, bool]], near: list[list[tuple[str, bool]]]) -> str:
    """``near``: the lines of neighbouring pages, nearest first."""
    other = next((o for o in near if o != lines), None)
    return _kept(lines, common_lines([x for x, _ in lines], [x for x, _ in other]) if other else set())


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _keys(lines: list[tuple[str, bool]]) -> list[tuple[bytes, bool]]:
    """Lines by their hashes, which are alike in all tasks."""
    return [(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest(), inside) for x, inside in lines]


@dataclass
class Run:
    """Consecutive pages of a host with the same lines, with their first and last path; ``lines`` is None if all lie in other partitions."""

    host: str
    first: str
    last: str
    keys: list[tuple[bytes, bool]] | bytes  # or their digest
    lines: list[tuple[str, bool]] | None = None
    page: tuple[str, str, int] | None = None  # one of its pages

    def goes_on(self, host: str, keys: list[tuple[bytes, bool]] | bytes) -> bool:
        return bool(host) and self.host == host and self.keys == keys

    def text(self, other: Run | None) -> str:
        if other is None or any(inside for _, inside in self.keys):
            return _kept(self.lines, set())
        return _kept(self.lines, common_lines([k for k, _ in self.keys], [k for k, _ in other.keys]))


def joined_runs(runs: Iterable[Run]) -> list[Run]:
    out: list[Run] = []
    for r in runs:
        if out and out[-1].goes_on(r.host, r.keys):
            out[-1] = replace(out[-1], last=r.last)
        else:
            out.append(r)
    return out


def digest(keys: list[tuple[bytes, bool]]) -> bytes | None:
    """None for a page without lines."""
    return hashlib.blake2b(b"".join(k + bytes([inside]) for k, inside in keys), digest_size=16).digest() if keys else None


def border_runs(pages: Iterable[tuple[str, str, int, bytes | None]]) -> tuple[list[Run], list[Run]]:
    """The first two and the last two runs of (host, path, hash, digest) in order."""
    firsts: list[Run] = []
    lasts: list[Run] = []
    runs = 0
    for host, path, h, found in pages:
        if found is None:
            continue
        if lasts and lasts[-1].goes_on(host, found):
            lasts[-1].last = path
            continue
        run = Run(host, path, path, found, page=(host, path, h))
        runs += 1
        if runs <= 2:
            firsts.append(replace(run))
        lasts = [*lasts[-1:], run]
    return firsts, lasts


def runs_around(borders: list[tuple[list[Run], list[Run]]]) -> list[tuple[list[Run], list[Run]]]:
    """Of each partition the two runs before and the two after it, from the :func:`border_runs` of all partitions in order."""
    before: list[list[Run]] = []
    after: list[list[Run]] = []
    near: list[Run] = []
    for _, lasts in borders:
        before.append(near)
        near = joined_runs([*near, *lasts])[-2:]
    near = []
    for firsts, _ in reversed(borders):
        after.append(near)
        near = joined_runs([*firsts, *near])[:2]
    return list(zip(before, reversed(after)))


def _differenced(pages: Iterable[tuple[str, str, str]], before: Iterable[Run] = (), after: Iterable[Run] = ()) -> Iterator[str]:
    """The text of each of the pages (host, path, html), which are in order."""
    older: Run | None = None
    run: Run | None = None
    waiting: list[str | None] = []  # paths of pages of the run, None for pages without lines

    def texts(newer: Run | None) -> Iterator[str]:
        left = older if older and run.host and older.host == run.host else None
        right = newer if newer and run and run.host and newer.host == run.host else None
        made: dict[bool, str] = {}
        for path in waiting:
            if path is None:
                yield ""
                continue
            to_right = right is not None and (left is None or _prefix(path, right.first) > _prefix(path, left.last))
            if to_right not in made:
                made[to_right] = run.text(right if to_right else left)
            yield made[to_right]

    def entries():
        yield from ((r, None) for r in before)
        last, lines, keys = None, [], []
        for host, path, html in pages:
            if html != last:
                lines = page_lines(html)
                last, keys = html, _keys(lines)
            yield Run(host, path, path, keys, lines), path
        yield from ((r, None) for r in after)

    for r, path in entries():
        if not r.keys:  # a page without lines teaches nothing
            waiting.append(None)
        elif run and run.goes_on(r.host, r.keys):
            run = replace(run, last=r.last, lines=run.lines or r.lines)
            if path is not None:
                waiting.append(path)
        else:
            if run:
                yield from texts(r)
                waiting = []
            older, run = run, r
            if path is not None:
                waiting.append(path)
    yield from texts(None)


def part_of(key: Column, cuts: list[tuple[str, str, int]]) -> Column:
    """How many of the sorted ``cuts`` are not above ``key`` (binary search)."""
    if not cuts:
        return F.lit(0)
    all_ = F.array(*(F.struct(*(F.lit(x) for x in c)) for c in cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(all_, n + step - 1) <= key, n + step).otherwise(n))


def extract(pages: DataFrame, html: str = "html", url: str = "url", partitions: int | None = None) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    key = ["__llm_host", "__llm_path", "__llm_h"]
    page_key = [host.alias(key[0]), path.alias(key[1]), F.xxhash64(html).alias(key[2])]
    read = pages.select(*kept, F.col(html).alias("__llm_html"), *page_key)
    keyed = pages.select(F.col(html).alias("__llm_html"), *page_key)

    def parse(make):
        def task(batches):
            for b in batches:
                found = [make(_keys(page_lines(x.as_py() or ""))) for x in b.column("__llm_html")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array(found, pa.binary())], names=[*key, "found"])

        return task

    def borders(batches):
        first: list = []
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*key, "found"))))

        def seen():
            for r in rows:
                if not first:
                    first.append(r[:3])
                yield r

        runs = border_runs(seen())
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((first[0], *runs))], pa.binary())], names=["runs"])

    # the cuts between partitions, and the runs beside them: a row for each partition
    digests = stored(keyed.mapInArrow(parse(digest), "__llm_host string, __llm_path string, __llm_h long, found binary"), "page-lines")
    cut = digests.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(borders, "runs binary").collect()
    parts = sorted((pickle.loads(r["runs"]) for r in cut), key=lambda x: x[0])
    around = runs_around([x[1:] for x in parts])
    wanted = sorted({r.page for sides in around for runs in sides for r in runs})
    at_cuts = spark.createDataFrame(wanted, "__llm_host string, __llm_path string, __llm_h long")
    at_cuts = keyed.join(F.broadcast(at_cuts), key, "left_semi").dropDuplicates(key).mapInArrow(parse(pickle.dumps), "__llm_host string, __llm_path string, __llm_h long, found binary")
    lines = {tuple(r)[:3]: pickle.loads(r["found"]) for r in at_cuts.collect()} if wanted else {}
    shared = spark.sparkContext.broadcast([[[replace(r, keys=lines[r.page]) for r in runs] for runs in sides] for sides in around])

    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    part = part_of(F.struct(*key), [x[0] for x in parts[1:]])
    ordered = read.withColumn("__llm_part", part).repartitionById(max(1, len(parts)), F.col("__llm_part")).sortWithinPartitions("__llm_part", *key)

    def task(batches):
        waiting: deque = deque()  # the kept columns of batches whose pages have not all been given out
        texts: list[str] = []

        def rows():
            for b in batches:
                if not b.num_rows:
                    continue
                waiting.append(b.select(kept))
                yield from zip(b.column("__llm_part").to_pylist(), b.column("__llm_host").to_pylist(), b.column("__llm_path").to_pylist(), b.column("__llm_html"))

        for i, some in itertools.groupby(rows(), lambda r: r[0]):
            for text in _differenced(((h, p, x.as_py() or "") for _, h, p, x in some), *shared.value[i]):
                texts.append(text)
                while waiting and len(texts) >= waiting[0].num_rows:
                    b = waiting.popleft()
                    done, texts[:] = texts[: b.num_rows], texts[b.num_rows :]
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns, pa.array(done, pa.string()), pa.array([len(x) for x in done], pa.int64())], names=[*kept, "text", "n_chars"])

    return ordered.mapInArrow(task, schema)
