"""Main text of HTML pages by wrappers that are inferred from the pages of a host.

A wrapper is a union-free regular expression over block tags: token streams of
one host are aligned one after another, mismatches become optional groups,
repeats become repeated groups, and texts become slots.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .urls import split_url

#: What HTML and usual names of classes say.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = "script|style|noscript|template|svg|iframe|object|textarea|select|math|canvas|audio|video"
BAD_TAGS = frozenset("head nav footer aside form button dialog menu fieldset".split())
ROOT_TAGS = ("article", "main")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsors?|sponsored|promos?|promotions?|side-?bars?|menus?|nav|navbar|navigation|breadcrumbs?|footers?|site-?headers?"
    r"|mastheads?|cookies?|consent|gdpr|notices?|banners?|alerts?|pop-?ups?|modals?|overlays?|newsletters?|subscribe|subscription|comments?|disqus|respond|replies|share|sharing|social|related"
    r"|recommended|widgets?|toolbars?|pagination|pager|login|signup|search(?:-?form|-?box)?)(?=$|[\s_-])",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)
#: Tags that end an open one of the same kind, as their end tags may be left out.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({OPAQUE})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[^<]+|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_BLANK = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


def blocks(page: str | None) -> list[tuple[str, str]]:
    """The page's blocks in order, each with its path of open block tags, like ``html>body>div.ad``."""
    out: list[tuple[str, str]] = []
    stack: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = _BLANK.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if joined:
                out.append((">".join(stack), joined))

    for m in _TOKEN.finditer(page or ""):
        name = m[3]
        if name is None:
            if m[1] is None and (m[0][0] != "<" or m[0] == "<"):
                text.append(m[0])
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
        if name in INLINE or name == "br":
            continue
        flush()
        if m[2]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at].split(".", 1)[0] == name:
                    del stack[at:]
                    break
        elif name not in VOID:
            if name in SELF_CLOSING and stack and stack[-1].split(".", 1)[0] == name:
                stack.pop()
            elif stack and stack[-1] == "p":  # a block ends a paragraph
                stack.pop()
            if not m[0].endswith("/>"):
                names = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[4])}
                marks = [*names.get("class", "").split(), *(["#" + names["id"]] if names.get("id") else []), *(["@" + names["role"].lower()] if names.get("role") else []), *(["!hidden"] if "hidden" in names or names.get("aria-hidden", "").lower() == "true" else [])]
                stack.append(".".join([name, *(_NUMBER.sub("0", x.replace(">", "").replace(".", "")) for x in marks)]))  # numbers tell pages apart, not slots
    flush()
    return out


def boilerplate(path: str) -> bool:
    """Whether some tag of the path holds no main text, by its kind, role or names."""
    inside = False
    for node in path.split(">"):
        tag, *marks = node.split(".")
        if tag in BAD_TAGS or (tag == "header" and not inside):
            return True
        for mark in marks:
            if mark[:1] == "@":
                if mark[1:] in BAD_ROLES:
                    return True
            elif mark == "!hidden" or (tag not in ("html", "body", *ROOT_TAGS) and BAD_NAMES.search(mark.lstrip("#"))):
                return True
        inside = inside or tag in ROOT_TAGS
    return False


def root_of(path: str) -> tuple[int, str]:
    """How likely the path's best container holds the article (smaller is likelier), and that container."""
    nodes = path.split(">")
    for rank, tag in enumerate(ROOT_TAGS):
        for i, node in enumerate(nodes):
            if node.split(".", 1)[0] == tag or (tag == "main" and "@main" in node.split(".")):
                return rank, ">".join(nodes[: i + 1])
    for i in range(len(nodes) - 1, 0, -1):
        if any(GOOD_NAMES.search(mark.lstrip("#")) for mark in nodes[i].split(".")[1:]):
            return 2, ">".join(nodes[: i + 1])
    return 3, "body"


def fold(tokens: list[str], longest: int = 12) -> list[str]:
    """Tandem repeats of up to ``longest`` tokens become one repeated group."""
    out: list[str] = []
    i = 0
    while i < len(tokens):
        for size in range(1, min(longest, (len(tokens) - i) // 2) + 1):
            unit = tokens[i : i + size]
            if unit == tokens[i + size : i + 2 * size]:
                i += size
                while tokens[i : i + size] == unit:
                    i += size
                part = unit[0] if size == 1 else "(" + " ".join(unit) + ")"
                out.append(part if part.endswith("+") else part + "+")
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def skeleton(found: list[tuple[str, str]]) -> list[str]:
    """The folded token stream of a page: its blocks' paths, each a text slot."""
    return fold([path for path, _ in found])


def align(wrapper: list[str], page: list[str]) -> list[str]:
    """The wrapper that also fits the page's stream.

    Matching tokens stay; a token that is once single and once repeated is
    repeated; what one side lacks becomes optional (marked ``?``).
    """
    plain = lambda t: t.rstrip("+?")
    a, b = [plain(t) for t in wrapper], [plain(t) for t in page]
    out: list[str] = []
    for what, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(wrapper[i:j], page[k:m]):
                marks = x[len(plain(x)) :] + y[len(plain(y)) :]
                out.append(plain(x) + "+" * ("+" in marks) + "?" * ("?" in marks))
        else:
            for t in [*wrapper[i:j], *page[k:m]]:
                out.append(t if t.endswith("?") else t + "?")
    folded = [out[0]] if out else []
    for t in out[1:]:  # neighbours that differ in marks only are one repeated token
        if plain(t) == plain(folded[-1]):
            folded[-1] = plain(t) + "+" + "?" * (t.endswith("?") and folded[-1].endswith("?"))
        else:
            folded.append(t)
    return folded


#: Wrappers are broadcast up to this many hosts and bytes of drop lists, and joined by shuffle beyond.
MAX_BROADCAST_HOSTS, MAX_BROADCAST_BYTES = 20_000, 16 << 20
#: Streams that one task aligns to one wrapper, about.
FAN_IN = 64


def slots(wrapper: list[str]) -> list[tuple[str, int]]:
    """(path, where it can go on) of each text slot of a wrapper: behind itself, at itself, or at the first slot of its group if that is repeated."""
    out: list[tuple[str, int]] = []
    for token in wrapper:
        paths, repeated = token.rstrip("+?").strip("()").split(" "), "+" in token
        first = len(out)
        for k, path in enumerate(paths):
            last = k == len(paths) - 1
            out.append((path, first if repeated and last else first + k + 1))
    return out


class Matcher:
    """Reads a page's blocks into the slots of its host's wrapper."""

    def __init__(self, wrapper: list[str]):
        self.slots = slots(wrapper)
        self.places: dict[str, list[int]] = {}
        for i, (path, _) in enumerate(self.slots):
            self.places.setdefault(path, []).append(i)

    def match(self, found: list[tuple[str, str]]) -> list[int]:
        """The slot of each block: the next one with its path; where the page goes back, the last one before; -1 if the wrapper has none."""
        out, at = [], 0
        for path, _ in found:
            places = self.places.get(path)
            if places is None:
                out.append(-1)
                continue
            k = bisect_left(places, at)
            slot = places[min(k, len(places) - 1)]
            out.append(slot)
            at = self.slots[slot][1]
        return out


def _streams(pages: DataFrame) -> DataFrame:
    """(host, value, pages): the different folded token streams of each host, as JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = (host, json.dumps(skeleton(blocks(page.as_py()))))
                seen[key] = seen.get(key, 0) + 1
            columns = list(zip(*[(*k, n) for k, n in seen.items()])) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["host", "value", "pages"])

    return pages.mapInArrow(run, "host string, value string, pages long").groupBy("host", "value").agg(F.sum("pages").alias("pages"))


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Streams of a host aligned one after another, the most frequent first."""
    rows = rows.sort_values(["pages", "value"], ascending=[False, True])
    wrapper: list[str] = []
    for i, value in enumerate(rows["value"]):
        page = json.loads(value)
        wrapper = align(wrapper, page) if i else page
    return pd.DataFrame({"host": rows["host"].iloc[:1], "value": [json.dumps(wrapper)], "pages": [int(rows["pages"].sum())]})


def wrappers_of(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages) of (host, html): a host's streams are aligned as a tree, FAN_IN of them in a task, so that a host of any size is no one group."""
    rows = durable(_streams(pages))
    while True:
        most = rows.groupBy("host").agg(F.count("*").alias("n"))
        size = most.agg(F.max("n")).first()[0] or 0
        if size <= 1:
            return rows.select("host", F.col("value").alias("wrapper"), "pages")
        parts = F.ceil(F.col("n") / FAN_IN)
        dealt = rows.join(F.broadcast(most) if most.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS else most, "host")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("value", F.lit(size)), parts))
        rows = durable(dealt.groupBy("host", "part").applyInPandas(lambda rows: _merge(rows), "host string, value string, pages long"))


def _with_wrappers(df: DataFrame, rules: DataFrame) -> DataFrame:
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()
    small = n <= MAX_BROADCAST_HOSTS and size <= MAX_BROADCAST_BYTES
    return df.join(F.broadcast(rules) if small else rules, "host", "left")


class Matchers(dict):
    """Matchers of wrappers given as JSON, kept while there is room."""

    def __missing__(self, wrapper: str) -> Matcher:
        if len(self) > 1000:
            self.clear()
        self[wrapper] = made = Matcher(json.loads(wrapper))
        return made


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper, root, drop) of every host of (host, html).

    ``wrapper`` is the aligned stream as JSON, ``root`` the container of the
    article and ``drop`` the numbers of the slots that hold no main text.  All
    pages are matched with their wrapper: outside of an article, a slot with the
    same text on all of at least three pages, while others vary, is a constant
    of the template.  Tags, roles and names decide on the other slots.
    """
    rules = durable(wrappers_of(pages))

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = Matchers()
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for host, page, wrapper in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = blocks(page.as_py())
                own: dict[int, list[int]] = {}
                for slot, (_, text) in zip(matchers[wrapper].match(found), found):
                    have = own.setdefault(slot, [0, 0])
                    have[0] += len(text)
                    have[1] = zlib.crc32(text.encode("utf-8", "surrogatepass"), have[1])
                for slot, (mass, crc) in own.items():
                    have = seen.setdefault((host, slot), [0, 0, crc, crc])
                    have[0] += 1
                    have[1] += mass
                    have[2], have[3] = min(have[2], crc), max(have[3], crc)
            columns = list(zip(*[(*k, *v) for k, v in seen.items()])) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string()] + [pa.int64()] * 5)], names=["host", "slot", "pages", "mass", "low", "high"])

    def classify(rows: pd.DataFrame) -> pd.DataFrame:
        host, wrapper, pages_ = rows["host"].iloc[0], rows["wrapper"].iloc[0], int(rows["of"].iloc[0])
        paths = [path for path, _ in slots(json.loads(wrapper))]
        varies = (rows["low"] != rows["high"]).any()
        drop, mass = [], {}
        for slot, n, low, high, size in zip(rows["slot"], rows["pages"], rows["low"], rows["high"], rows["mass"]):
            if slot < 0:
                continue
            rank, root = root_of(paths[slot])
            constant = varies and low == high and n >= 3 and n == pages_ and rank > 1
            if boilerplate(paths[slot]) or constant:
                drop.append(int(slot))
            else:
                mass[rank, root] = mass.get((rank, root), 0) + int(size)
        best = min((r for r, _ in mass), default=3)
        root = max((m, r) for (k, r), m in mass.items() if k == best)[1] if mass else "body"
        return pd.DataFrame({"host": [host], "wrapper": [wrapper], "root": [root if best == 2 else ROOT_TAGS[best] if best < 2 else "body"], "drop": [sorted(drop)]})

    met = _with_wrappers(pages.select("host", "html"), rules.select("host", "wrapper")).select("host", "html", "wrapper")
    seen = met.mapInArrow(observe, "host string, slot long, pages long, mass long, low long, high long")
    seen = seen.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("mass").alias("mass"), F.min("low").alias("low"), F.max("high").alias("high"))
    judged = seen.join(rules.select("host", "wrapper", F.col("pages").alias("of")), "host").groupBy("host").applyInPandas(classify, "host string, wrapper string, root string, drop array<int>")
    rest = rules.join(judged.select("host"), "host", "left_anti").select("host", "wrapper", F.lit("body").alias("root"), F.array().cast("array<int>").alias("drop"))
    return judged.unionByName(rest)


def main_text(found: list[tuple[str, str]], root: str, drop: frozenset[int] = frozenset(), slots_: list[int] | None = None) -> str:
    """The blocks in the wrapper's slots inside of the host's root; of the likeliest container, or all, where the page lacks it."""
    slots_ = slots_ if slots_ is not None else [-1] * len(found)
    good = [(path, text) for (path, text), slot in zip(found, slots_) if slot not in drop and (slot >= 0 or not boilerplate(path))]
    if root in ROOT_TAGS:
        rank = ROOT_TAGS.index(root)
        inside = [t for p, t in good if any(n.split(".", 1)[0] == root or (rank and "@main" in n.split(".")) for n in p.split(">"))]
    else:
        inside = [t for p, t in good if root == "body" or p == root or p.startswith(root + ">")]
    if not inside and good:
        best = min(root_of(p)[0] for p, _ in good)
        inside = [t for p, t in good if root_of(p)[0] == best]
    return "\n".join(inside)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, host and the main text of every page from its whole html.

    Null and empty html, and pages without main text, give an empty text; null
    urls share the empty host.  Repeated rows get a row each; other columns are
    not read.
    """
    host, _ = split_url(F.col("url"))
    df = pages.select(host.alias("host"), F.col("html").cast("string").alias("html"), "page_id", F.col("url").cast("string").alias("url"))
    rules = durable(infer(df.select("host", "html")))
    joined = _with_wrappers(df, rules).select("page_id", "url", "host", "html", "wrapper", "root", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = Matchers()
        drops: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            for host, page, wrapper, root, drop in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6)):
                if host not in drops:
                    if len(drops) > 1000:
                        drops.clear()
                    drops[host] = frozenset(drop.as_py() or ())
                found = blocks(page.as_py())
                texts.append(main_text(found, root or "body", drops[host], matchers[wrapper or "[]"].match(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string())], names=["page_id", "url", "host", "text"])

    kind = dict(df.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, host string, text string")
