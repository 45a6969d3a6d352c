"""HTML extraction with wrappers: union-free regular expressions inferred for each host.

A page's structural tags and texts are a token stream. A text that not all different pages of a host have becomes a slot
at once; one that all have keeps its hash (from CONSTANT_PAGES different pages on). Consecutive repeats fold into repeated
groups. The streams of a host are aligned with each other: what both have stays, what one lacks becomes optional, a
single and a repeated group become a repeated one. A hashed text that the alignment leaves in place is constant, one that it
makes optional is a slot. Streams are counted with partial aggregation first, so a hot host costs no more than its different
streams, which merge in rounds of groups of about MERGED, each round written. Stretches without a common part
become optional groups of each of their tokens, whatever their length, so a wrapper does not grow with its pages. Wrapper and region are joined to
the pages, and each page's text is read from the slots in the region.

The main text is the region (`article`, else `main`, else the smallest element whose whole subtree holds four fifths of
the text in slots over the host's pages) without menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments, by tag, role, class or id, whatever element it is, and without what is hidden; a heading in the header of an article is its
title and stays. No text of an `article` or `main` goes because all pages of the host have it: its author says that it is the text. Elsewhere texts
constant over the host go. Character references are decoded; white space inside a block is one space; blocks are joined by one.

Defined cases: a null or empty html is an empty text; a null url is the host ""; unclosed elements end with their
container, and p, li, dd, dt, cells and headings with the next one as in HTML; quotes delimit only what follows an equals sign, and
a tag that the end of the page cuts off is dropped; an article inside or after another one is noise by class or id as well; of equally
large regions the deepest is taken; each input row gives one result row, repeated ones the same; a very long page is read in one
pass; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, materialize

#: What stands in a tag after its name; nothing of it is tried twice, so a page is read in one pass.
INSIDE = r"""((?>[\s/]+|=?[^\s/>=]+(?>\s*=\s*(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?|=)*+)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|svg|iframe|title)(?=[\s/>]){INSIDE}(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+){INSIDE}(>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]+|<", re.S | re.I)
#: Comments, declarations and closing tags without a name.
DROPPED = re.compile(r"<[!?/]")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body article main section div aside nav header footer form fieldset ul ol dl table td th tr figure details dialog menu blockquote".split())
NOISE_TAGS = frozenset("head nav header footer aside form menu dialog button select script style noscript template iframe svg".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header comment comments commentlist disqus reply replies respond share sharing social related recommended widget toolbar skip pagination login signup paywall".split()
)
#: Words that name noise by themselves, at the end of a name, or before words for parts of a page; before others they say what a text is about.
AMBIGUOUS = frozenset("alert notice notices promotion related share sharing skip social".split())
PARTS = frozenset("action actions area articles bar block body bottom box btn button buttons col container content danger error field footer form group heading header icon icons image info inner item items label left link links list main media message meta nav networks news notice now on outer panel popup posts primary products respond right row section sidebar slot stories success tags text this thread title to toggle tools top topics unit videos warning widget with wrap wrapper".split())
#: Words after a name of noise that make it what a text is about, or say that it is not there.
SUBJECTS = frozenset("about day for free history less of photo photos picture recipe story the".split())
#: Words after ad that make it no advert.
LATIN = frozenset("hoc hominem infinitum lib libitum nauseam valorem".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar form alert dialog alertdialog".split())


HEAD = frozenset("head base basefont bgsound link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("table td th caption".split())
#: Start tags that end a paragraph, and those that end others: the ended elements and the elements beyond which none is ended.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section table ul".split())
LISTS, ROWS = frozenset("ul ol menu".split()), frozenset("tr td th".split())
ENDS = (
    {"li": (frozenset(["li"]), LISTS), "tr": (ROWS, frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"]))}
    | {t: (frozenset(["dd", "dt"]), frozenset(["dl"])) for t in ("dd", "dt")}
    | {t: (frozenset(["td", "th"]), frozenset(["tr", "table"])) for t in ("td", "th")}
    | {t: (ROWS | {"thead", "tbody", "tfoot"}, frozenset(["table"])) for t in ("thead", "tbody", "tfoot")}
    | {t: (HEADINGS, CONTAINERS) for t in HEADINGS}
)


#: Streams merged at once, about.
MERGED = 8
#: A text in a token stream.
HASHED = re.compile("#[0-9a-f]{16}")
#: A text in all of at least so many different pages of a host can be the host's; with fewer, copies look the same.
CONSTANT_PAGES = 5


def digest(words: str) -> int:
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Every:
    """Every hash."""

    def __contains__(self, _: object) -> bool:
        return True


def slot(words: str, constant: Container[int]) -> str:
    """The token of a text: # for a slot, with its hash where it may be constant."""
    if not constant:
        return "#"
    d = digest(words)
    return f"#{d % 2**64:016x}" if d in constant else "#"


def noise(tag: str, attributes: str, later: bool = False) -> bool:
    """Whether an element is noise by tag, role, class or id; later: an article inside or after another one, where it may be a comment."""
    if tag in NOISE_TAGS:
        return True
    if tag in ("html", "body", "main") or tag == "article" and not later or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "style" and HIDDEN.search(value):
            return True
        if name == "role" and value in ROLES or name in ("class", "id") and any(map(names_noise, value.split())):
            return True
    return False


def names_noise(name: str) -> bool:
    """Whether a class or id is noise by its words."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    for i, w in enumerate(words):
        rest = words[i + 1 :]
        if w in NOISE and not (w == "ad" and rest and rest[0] in LATIN) and SUBJECTS.isdisjoint(rest) and (w not in AMBIGUOUS or PARTS.issuperset(rest)):
            return True
    return False


def kind(tag: str, attributes: str) -> str:
    """An element's name in streams: its tag and, for containers, its class."""
    if tag in ("article", "main", "body"):
        return tag
    m = re.search(r"class\s*=\s*[\"']?([\w-]+)", attributes) if tag in CONTAINERS and attributes else None
    return tag + (f".{m[1].lower()}" if m else "")


def titles(stack: list[tuple[str, str, bool]]) -> bool:
    """Whether the one element of noise that is open is a header inside an article: a heading in it is the article's title."""
    at = next(i for i, x in enumerate(stack) if x[2] > 0)
    return stack[at][0] == "header" and any(x[0] == "article" for x in stack[:at])


def walk(page: str, roots: tuple[str, ...] = (), constant: Container[int] = ()) -> tuple[list[str], list[int], list[tuple[str, list[bool]]], set[str]]:
    """(structural tags and texts, characters of each text, blocks of text in slots, or in an article or main, and which of roots each is in, containers that are no
    noise) of a page. Noise is marked ! and has no text."""
    tokens: list[str] = []
    sizes: list[int] = []
    blocks: list[tuple[str, list[bool]]] = []
    regions: set[str] = set()
    stack: list[tuple[str, str, bool]] = []
    text: list[str] = []
    tags: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    skip, articles = 0, False

    def flush() -> None:
        if not text:
            return
        joined = "".join(text)
        words = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
        text.clear()
        if words:
            tokens.append(slot(words, constant))
            sizes.append(len(words))
            if tokens[-1] == "#" or kinds["article"] or kinds["main"]:
                blocks.append((words, [kinds[r] > 0 for r in roots]))

    def close(at: int) -> None:
        nonlocal skip
        while len(stack) > at:
            tag, name, bad = stack.pop()
            skip, tags[tag], kinds[name] = skip - bad, tags[tag] - 1, kinds[name] - 1
            if tag in CONTAINERS:
                tokens.append("/" + tag)

    def open_at(wanted: frozenset[str], bounds: frozenset[str], first: bool) -> int | None:
        """Place of the innermost (or first) open element of wanted within bounds."""
        found = None
        if not any(tags[t] for t in wanted):
            return None
        for i in range(len(stack) - 1, -1, -1):
            tag = stack[i][0]
            if tag in wanted:
                found = i
                if not first:
                    break
            elif tag in bounds:
                break
        return found

    for m in TOKEN.finditer(page):
        tag = m[4]
        if tag is None or not m[6]:
            if tag is None and not skip and not m[1] and not DROPPED.match(m[0]):
                text.append(m[0])
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag in VOID:
                continue
            if m[3] or tag == "a":
                at = open_at(frozenset([tag]), CELLS, False)
                if at is not None:
                    skip, tags[tag], kinds[""] = skip - stack.pop(at)[2], tags[tag] - 1, kinds[""] - 1
            if not m[3]:
                bad = noise(tag, m[5])
                stack.append((tag, "", bad))
                skip, tags[tag], kinds[""] = skip + bad, tags[tag] + 1, kinds[""] + 1
            continue
        flush()
        if m[3]:
            bounds = frozenset() if tag in CONTAINERS or tag in NOISE_TAGS else LISTS | CELLS if tag == "li" else CONTAINERS
            at = open_at(frozenset([tag]), bounds, False)
            if at is not None:
                close(at)
            continue
        if tag not in HEAD and (at := open_at(frozenset(["head"]), frozenset(["body"]), False)) is not None:
            close(at)
        if tag in ENDS_P and (at := open_at(frozenset(["p"]), CELLS, False)) is not None:
            close(at)
        if tag in ENDS and (at := open_at(*ENDS[tag], True)) is not None:
            close(at)
        if tag in VOID:
            continue
        bad = -1 if tag in HEADINGS and skip == 1 and tags["article"] and titles(stack) else noise(tag, m[5], articles)
        name = kind(tag, m[5])
        stack.append((tag, name if tag in CONTAINERS else "", bad))
        skip, tags[tag], kinds[stack[-1][1]] = skip + bad, tags[tag] + 1, kinds[stack[-1][1]] + 1
        tokens.append(("!" if skip else "") + name)
        if not skip:
            articles = articles or tag == "article"
            if tag in CONTAINERS:
                regions.add(name)
    flush()
    close(0)
    return tokens, sizes, blocks, regions


def held(tokens: list[str], sizes: list[int]) -> dict[str, list[int]]:
    """Of each container that is no noise the characters in slots of its whole subtree, and these times its depth; of the page under ""."""
    out: dict[str, list[int]] = {}
    begun: dict[str, tuple[int, int]] = {}
    stack: list[str] = []
    kinds: Counter[str] = Counter()
    chars, texts = 0, iter(sizes)
    for t in tokens:
        if t[0] == "#":
            n = next(texts)
            chars += n if t == "#" else 0
        elif t[0] == "/":
            name = stack.pop()
            kinds[name] -= 1
            if not kinds[name] and name in out:
                at, depth = begun[name]
                out[name][0] += chars - at
                out[name][1] += (chars - at) * depth
        else:
            name = t.lstrip("!")
            if name.split(".")[0] in CONTAINERS:
                stack.append(name)
                kinds[name] += 1
                if t[0] != "!":
                    out.setdefault(name, [0, 0])
                if kinds[name] == 1:
                    begun[name] = (chars, len(stack))
    out[""] = [chars, 0]
    return out


def stream(tokens: list[str]) -> list[str]:
    """Tokens with neighbouring slots as one."""
    out: list[str] = []
    for t in tokens:
        if t != "#" or not out or out[-1] != "#":
            out.append(t)
    return out


def repeats(tokens: list[str], size: int) -> bool:
    """Whether size tokens stand twice in a row, or behind a group that may take them in."""
    run = 0
    for x, y in zip(tokens, tokens[size:], strict=False):
        run = run + 1 if x == y else 0
        if run == size:
            return True
    return False


def fold(tokens: list[str], longest: int = 8) -> list[str]:
    """Consecutive repeats of up to longest tokens as one group (x y)+, shortest first, until none is left."""
    grouped = any(t[-1] == "+" for t in tokens)
    for size in range(1, longest + 1):
        if not grouped and not repeats(tokens, size):
            continue
        grouped, out = True, []
        for t in tokens:
            out.append(t)
            if len(out) >= 2 * size and out[-1] == out[-1 - size] and out[-size:] == out[-2 * size : -size]:
                del out[-size:]
                if size == 1:
                    out[-1] = out[-1] if out[-1].endswith("+") else f"({out[-1]})+"
                else:
                    out[-size:] = [f"({' '.join(out[-size:])})+"]
            elif size < len(out) and out[-size - 1][-1] == "+" and out[-size - 1] == f"({' '.join(out[-size:])})+":
                del out[-size:]
        tokens = out
    return tokens


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal tokens, rising in both: the n-th of a token in one is paired with the n-th in the other, and of these pairs the longest rising run stays; then the same
    between its neighbours, until nothing there is in both. Texts go before tags, which are many and alike. Each pass takes n log n steps, whatever the tokens are."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b), True)]
    while gaps:
        i, m, j, n, texts = gaps.pop()
        at: dict[str, list[int]] = {}
        for y in range(n - 1, j - 1, -1):
            if not texts or HASHED.search(b[y]):
                at.setdefault(b[y], []).append(y)
        pairs = [(x, at[a[x]].pop()) for x in range(i, m) if at.get(a[x])]
        ends: list[int] = []
        last, before = [], [-1] * len(pairs)  # the pair that ends the best run of each length, and the one before each pair
        for k, (_, y) in enumerate(pairs):
            r = bisect_left(ends, y)
            before[k] = last[r - 1] if r else -1
            ends[r : r + 1], last[r : r + 1] = [y], [k]
        run, k = [], last[-1] if last else -1
        while k >= 0:
            run.append(pairs[k])
            k = before[k]
        run.reverse()
        found += run
        if not run and texts:
            gaps.append((i, m, j, n, False))
        for (x, y), (u, v) in zip([(i - 1, j - 1), *run], [*run, (m, n)], strict=True):
            if run and u - x > 1 and v - y > 1:
                gaps.append((x + 1, u, y + 1, v, texts))
    return sorted(found)


def align(one: list[str], two: list[str]) -> list[str]:
    """A wrapper that both fit: tokens between what is in both become optional groups, each once, x and (x)+ become (x)+."""

    def bare(x: str) -> str:
        x = x.removesuffix("?")
        return x[1:-2] if x.startswith("(") and x.endswith(")+") else x

    a, b = [bare(x) for x in one], [bare(x) for x in two]
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]), strict=False)) if x != y), min(len(a), len(b)) - head)
    out: list[str] = []

    def both(xs: list[str], ys: list[str]) -> None:
        for x, y in zip(xs, ys, strict=True):
            group = x if x.removesuffix("?").endswith("+") else y
            out.append(group.removesuffix("?") + ("?" if x.endswith("?") or y.endswith("?") else ""))

    both(one[:head], two[:head])
    one, two, a, b, rest = one[head : len(one) - tail], two[head : len(two) - tail], a[head : len(a) - tail], b[head : len(b) - tail], (one[len(one) - tail :], two[len(two) - tail :])
    i = j = 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        out += [f"({t})+?" for t in dict.fromkeys(a[i:x] + b[j:y])]
        both(one[x : x + 1], two[y : y + 1])
        i, j = x + 1, y + 1
    both(*rest)
    return out


def region(wrapper: list[str], most: str | None) -> str:
    """The element that holds the main text; most: the smallest that holds most of the text."""
    flat = re.findall(r"[^\s()+?]+", " ".join(wrapper))
    return next((tag for tag in ("article", "main") if tag in flat), most or "body")


def constants(wrapper: list[str]) -> list[int]:
    """Hashes of texts that the wrapper has in every page."""
    found = {int(h, 16) for t in wrapper if not t.endswith("?") for h in re.findall(r"#([0-9a-f]{16})(?!\?|\)\+\?)", t)}
    return sorted(h - 2**64 if h >= 2**63 else h for h in found)


def main_text(page: str, root: str, constant: Container[int] = ()) -> str:
    """The text in slots of the region root of a page, or of the whole page without noise where it has no such region; of an article or main also what all pages have."""
    roots = (root, "article", "main")
    _, _, blocks, regions = walk(page, roots, constant)
    wanted = next((i for i, x in enumerate(roots) if x in regions), None)
    return " ".join(words for words, inside in blocks if wanted is None or inside[wanted])


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def merged(streams: pd.Series) -> str:
    """One wrapper of a host's streams, in a fixed order; the order is by length, so that short ones do not hide groups."""
    wrapper: list[str] | None = None
    for s in sorted(set(streams), key=lambda x: (len(x), x)):
        tokens = json.loads(s)
        wrapper = tokens if wrapper is None else fold(align(wrapper, tokens))
    return json.dumps(wrapper or [])


def described(pages: DataFrame) -> DataFrame:
    """(host, tokens, sizes, pages), written: every different page of a host as its tokens, every text hashed, with the characters of each text and how
    many rows have it. This is the only time that pages are read before their text is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, str], list] = {}
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                tokens, sizes, _, _ = walk(html, (), Every())
                seen.setdefault((host, " ".join(tokens)), [sizes, 0])[1] += 1
            if seen:
                hosts, tokens = zip(*seen, strict=True)
                sizes, n = zip(*seen.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.string()), pa.array(sizes, pa.list_(pa.int32())), pa.array(n, pa.int64())], ["host", "tokens", "sizes", "pages"])

    each = pages.mapInArrow(run, "host string, tokens string, sizes array<int>, pages long")
    return materialize(each.groupBy("host", "tokens").agg(F.first("sizes").alias("sizes"), F.sum("pages").alias("pages")), "page-tokens", compression="zstd")


def shared_texts(pages: DataFrame) -> DataFrame:
    """(host, shared): hashes of the texts that all different pages of a host with a text have, of CONSTANT_PAGES pages at least. pages: as described."""
    texts = F.array_distinct(F.regexp_extract_all("tokens", F.lit("#([0-9a-f]{16})"), F.lit(1)))
    each = pages.select("host", texts.alias("texts")).filter(F.size("texts") > 0)
    counted = each.select("host", F.explode(F.concat("texts", F.array(F.lit("")))).alias("h")).groupBy("host", "h").count()
    counted = materialize(counted.filter(F.col("count") >= CONSTANT_PAGES), "host-texts")
    whole = counted.filter("h = ''").select("host", F.col("count").alias("whole"))
    return counted.filter("h <> ''").join(whole, "host").filter("count = whole").groupBy("host").agg(F.array_sort(F.collect_set("h")).alias("shared"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, root, constant) of every host."""
    bounded_batches(pages.sparkSession)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str, str], list[int]] = {}
            for host, tokens, sizes, pages, shared in zip(*(b.column(c).to_pylist() for c in ("host", "tokens", "sizes", "pages", "shared")), strict=True):
                known = frozenset(shared or ())
                tokens = [t if t[0] != "#" or t[1:] in known else "#" for t in tokens.split(" ")] if tokens else []
                one = json.dumps(fold(stream(tokens)))
                for kind, (chars, deep) in held(tokens, sizes).items():
                    total = sums.setdefault((host, one, kind), [0, 0])
                    total[0] += chars * pages
                    total[1] += deep * pages
            rows = [(*k, *v) for k, v in sums.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "stream", "kind", "chars", "deep"])

    @F.pandas_udf("string")
    def merge(streams: pd.Series) -> str:
        return merged(streams)

    @F.pandas_udf("root string, constant array<long>")
    def read(wrapper: pd.Series, most: pd.Series) -> pd.DataFrame:
        rows = [(json.loads(w), m) for w, m in zip(wrapper, most, strict=True)]
        return pd.DataFrame({"root": [region(w, m) for w, m in rows], "constant": [constants(w) for w, _ in rows]})

    own = described(pages.select(host().alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html")))
    rows = own.join(materialize(shared_texts(own), "shared-texts"), "host", "left")
    each = rows.select("host", "tokens", "sizes", "pages", "shared").mapInArrow(folded, "host string, stream string, kind string, chars long, deep long")
    each = materialize(each.groupBy("host", "stream", "kind").agg(F.sum("chars").alias("chars"), F.sum("deep").alias("deep")), "streams")
    discard(own)
    sums = each.groupBy("host", "kind").agg(F.sum("chars").alias("chars"), F.sum("deep").alias("deep"))
    whole = sums.filter("kind = ''").select("host", F.col("chars").alias("whole"))
    most = sums.filter("kind <> '' and chars > 0").join(whole, "host").filter("5 * chars >= 4 * whole").groupBy("host").agg(F.expr("min_by(kind, struct(chars, -deep / chars, kind))").alias("most"))
    left = each.filter("kind = ''").select("host", "stream")
    while True:
        n = left.groupBy("host").agg(F.count("*").alias("n"))
        if (n.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        block = F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / MERGED)).alias("block")
        after = materialize(left.join(n, "host").groupBy("host", block).agg(merge("stream").alias("stream")).select("host", "stream"), "streams")
        if left is not each:
            discard(left)
        left = after
    one = left.withColumnRenamed("stream", "wrapper").join(most, "host", "left")
    return materialize(one.withColumn("r", read("wrapper", "most")).select("host", "wrapper", "r.root", "r.constant"), "wrappers")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, wrapper's root) of every row."""

    @F.arrow_udf("string")
    def text(html: pa.Array, root: pa.Array, constant: pa.Array) -> pa.Array:
        return pa.array([main_text(h, r, frozenset(c)) for h, r, c in zip(html.to_pylist(), root.to_pylist(), constant.to_pylist(), strict=True)], pa.string())

    w = wrappers(pages).select(F.col("host").alias("__host"), "root", "constant")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host().alias("host"))
    return rows.join(w, rows["host"] == w["__host"], "left").select("page_id", "url", text("html", F.coalesce("root", F.lit("body")), F.coalesce("constant", F.array().cast("array<long>"))).alias("text"), "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return e.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
