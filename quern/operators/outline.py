"""Document structuring (D1-D40). Line-wise steps are expressions and windows per book; folds with a running state are pandas per book."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import schemas as S
from quern.functions import text as X
from quern.functions.similarity import dice
from quern.shared import drop_scratch, scratch

#: The patterns of headings, contents lines, section marks, lesson titles and front matter.
NUMBER = "[0-9一二三四五六七八九十百千万]+"
HEADING = r"^#{1,6}\s+.+"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
HEADING_NOISE = r"""[#*_`~\[\]().,，。:：;；!?！？/\\|"《》“”‘’、\-]+"""
TOC_LEADER = r"^(.*?)\s*(?:[.·•…．。]{2,}|[─—-]{2,}|/)\s*(\d+)\s*$"
TOC_CHAPTER = r"^(第\s*\S+\s*章\s+\S.*?)\s+(\d+)\s*$"
CHAPTER, SECTION, DOTTED = rf"^第\s*({NUMBER})\s*章\s*(.+)$", rf"^第\s*({NUMBER})\s*节\s*(.+)$", r"^(\d+(?:\.\d+)+)\s+(.+)$"
APPENDIX, BOUNDARY = r"^附\s*录", "复习|练习|小结|总结"
SECTION_DOTS, SECTION_MARK = r"\d+(?:\.\d+)+", rf"第{NUMBER}(?:章|节|课|单元)"
LEADING_NUMBER = rf"^\s*(?:\d+(?:\s*[.．]\s*\d+)+|第\s*{NUMBER}\s*(?:章|节|课|单元)|[一二三四五六七八九十百千万]+[、.])\s*"
NUMBER_ONLY = rf"^(?:\d+(?:\.\d+)+|第{NUMBER}(?:章|节|课|单元)|[一二三四五六七八九十百千万]+[、.])$"
LESSON_START = r'LESSON_START\s+id="([^"]+)"'
CONTENTS_HEADING, CONTENTS_LINE, APPENDIX_HEADING = r"^(目\s*录|contents)$", r"^(#{1,6}\s*)?目\s*录\s*$", r"^(附\s*录|appendix)"
LESSON_TITLE, LESSON_NUMBER = rf"^第\s*{NUMBER}\s*[节课]\s+", r"^[0-9]+\.[0-9]+(?:\.[0-9]+)?\s+\S"
TITLE_CAPITALS, TITLE_KEEP = r"[A-Z]{2,}(?:\s+[A-Z]{2,})*", "[一-龥]"
TITLE_DROP = "普通高中教科书|上海|出版社|主编|编写|责任编辑|ISBN|版权所有|声明|印刷|发行|书号|定价"
DIGITS = dict(zip("零一二两三四五六七八九", (0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))


def lines(markdown: DataFrame, text: str = "md") -> DataFrame:
    """book_id, line (from 1), text."""
    return markdown.select("book_id", F.posexplode(F.split(text, "\n")).alias("n", "text")).select("book_id", (F.col("n") + 1).alias("line"), "text")


def headings(markdown: DataFrame) -> DataFrame:
    """D3: markdown headings: book_id, line, level, text."""
    m = lines(markdown).where(F.col("text").rlike(HEADING))
    return m.select("book_id", "line", F.char_length(F.regexp_extract("text", r"^(#{1,6})\s", 1)).alias("level"), F.trim(F.regexp_extract("text", r"^#{1,6}\s+(.+)", 1)).alias("text"))


def flatten(items: DataFrame) -> DataFrame:
    """Breadth-first order of a forest with parent pointers (book_id, id, parent_id, pos): depth and place.

    One join and one written table per level, as many as the forest is deep. Items that no root reaches are left out.
    """
    level = scratch(items.where("parent_id IS NULL").withColumn("depth", F.lit(0)).withColumn("path", F.array("pos")), "outline")
    out, rest, depth = level, items.where("parent_id IS NOT NULL"), 0
    while not level.isEmpty():
        depth += 1
        up = level.select("book_id", F.col("id").alias("parent_id"), F.col("path").alias("up"))
        level = rest.join(up, ["book_id", "parent_id"]).withColumn("depth", F.lit(depth)).withColumn("path", F.concat("up", F.array("pos"))).select(*out.columns)
        level = scratch(level, "outline")
        out = out.unionByName(level)
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("depth", "path"))
    return out.withColumn("place", place)


def resolve_anchors(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Anchors to item ids: the exact id, else the only item with the anchor among kind:local, kind-local and local.

    Returns anchor, id (null if none or several), n (matches): strict callers treat n <> 1 as an error.
    """
    kind, local = F.split_part("id", F.lit(":"), F.lit(3)), F.regexp_extract("id", r"^[^:]+:[^:]+:[^:]+:(.+)$", 1)
    names = F.array_distinct(F.array(F.concat_ws(":", kind, local), F.concat_ws("-", kind, local), local))
    variants = items.select("id", F.explode(names).alias("anchor"))
    exact = queries.join(items.select(F.col("id").alias("anchor"), F.col("id").alias("exact")), "anchor", "left")
    found = variants.groupBy("anchor").agg(F.countDistinct("id").alias("k"), F.min("id").alias("one"))
    j = exact.join(found, "anchor", "left")
    n = F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("k", F.lit(0)))
    return j.select("anchor", F.coalesce("exact", F.when(F.col("k") == 1, F.col("one"))).alias("id"), n.alias("n"))


def span(start: str, end: str) -> Column:
    """Lines or pages of an item; 0 if an end is missing."""
    return F.coalesce(F.col(end) - F.col(start) + 1, F.lit(0))


def ancestors(items: DataFrame) -> DataFrame:
    """Ancestor closure (book_id, id, ancestor, distance) of parent pointers.

    Each round joins the closure with itself and so doubles its reach, until no pair is new: a depth of n takes log n rounds.
    """
    out = scratch(items.where("parent_id IS NOT NULL").select("book_id", "id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")), "outline")
    n = out.count()
    while n:
        onward = out.toDF("book_id", "ancestor", "next", "more")
        more = out.join(onward, ["book_id", "ancestor"]).select("book_id", "id", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        both = scratch(out.union(more).groupBy("book_id", "id", "ancestor").agg(F.min("distance").alias("distance")), "outline")
        drop_scratch(out)
        out, was, n = both, n, both.count()
        if n == was:
            break
    return out


def nearest(items: DataFrame, kind: str) -> DataFrame:
    """Per item its nearest ancestor of a kind (null if none)."""
    a = ancestors(items).join(items.where(F.col("kind") == kind).select("book_id", F.col("id").alias("ancestor")), ["book_id", "ancestor"])
    best = a.groupBy("book_id", "id").agg(F.min(F.struct("distance", "ancestor")).alias("b")).select("book_id", "id", F.col("b.ancestor").alias(kind))
    return items.select("book_id", "id").join(best, ["book_id", "id"], "left")


# --- chunk planning (D7-D10) ---------------------------------------------------------------------------------------


def role_of(title: str, label: str = "", explicit: str = "") -> str:
    """Driver- and worker-side form of ``content_role``."""
    if explicit in ("knowledge", "summary", "assessment", "excluded"):
        return explicit
    shown = f"{title.strip()} {label.strip()}".strip()
    for role, pattern in (("assessment", S.ASSESSMENT_TITLE), ("summary", S.SUMMARY_TITLE), ("excluded", S.EXCLUDED_TITLE)):
        if re.search(pattern, shown):
            return role
    return "knowledge"


@dataclass
class Leaf:
    id: str
    kind: str
    title: str
    start: int
    end: int
    role: str
    topic: str = ""
    chapter: str = ""

    @property
    def size(self) -> int:
        return self.end - self.start + 1 if self.end else 0


@dataclass
class Chunk:
    start: int
    end: int
    role: str
    title: str
    sources: list[str] = field(default_factory=list)
    how: str = "normal"

    @property
    def size(self) -> int:
        return self.end - self.start + 1


def group_small(leaves: list[Leaf], least: int, most: int) -> list[list[Leaf]]:
    """Short lessons take in what follows (activities, other short items) of the same role while the sum fits;
    an activity joins a lone predecessor of its role if both fit."""
    out: list[list[Leaf]] = []
    open_group = False  # whether the last group may take in more
    for x in leaves:
        last = out[-1] if out else None
        if last and open_group and x.role == last[0].role and (x.kind == "activity" or x.size < least) and sum(y.size for y in last) + x.size <= most:
            last.append(x)
            continue
        if x.kind == "activity":
            if last and len(last) == 1 and last[0].role == x.role and last[0].size + x.size <= most:
                last.append(x)
            else:
                out.append([x])
            open_group = False
            continue
        out.append([x])
        open_group = x.kind == "lesson" and x.size < least
    return out


def split_large(leaf: Leaf, heads: list[tuple[int, str]], target: int, most: int) -> list[Chunk]:
    """Cut an oversized item (or one with headings of another role) at its headings.

    Sections under max(target/4, 30) lines join their neighbour of the same role; a chunk closes when the role changes or
    it would pass 1.3 targets; small chunks at the end go back to the one before.
    """
    inner = [(n, t) for n, t in heads if leaf.start <= n <= leaf.end]
    role = lambda t: (r if (r := role_of(t)) not in ("knowledge", "excluded") else leaf.role) if t else leaf.role
    whole = [Chunk(leaf.start, leaf.end, leaf.role, leaf.title, [leaf.id])]
    if not inner or (leaf.size <= most and all(role(t) == leaf.role for _, t in inner)):
        return whole
    title_at = {}
    for n, t in inner:
        title_at.setdefault(n, t)
    cuts = sorted({leaf.start, *title_at})
    sections = [Chunk(a, b - 1, role(title_at.get(a, "")), title_at.get(a, "")) for a, b in zip(cuts, [*cuts[1:], leaf.end + 1], strict=True)]
    small = max(target // 4, 30)

    def absorb(parts: list[Chunk], test) -> list[Chunk]:
        out: list[Chunk] = []
        for p in parts:
            if out and test(out[-1], p):
                out[-1].end, out[-1].title = p.end, out[-1].title or p.title
            else:
                out.append(p)
        return out

    sections = absorb(sections, lambda a, b: a.size < small and a.role == b.role)
    chunks = absorb(sections, lambda a, b: a.role == b.role and a.size + b.size <= target * 1.3)
    chunks = absorb(chunks, lambda a, b: b.size < small and a.role == b.role)
    for c in chunks:
        c.sources, c.how, c.title = [leaf.id], "split", c.title or leaf.title
    return chunks


def plan_book(leaves: list[Leaf], heads: list[tuple[int, str]], least: int = S.CHUNK_MIN, target: int = S.CHUNK_TARGET, most: int = S.CHUNK_MAX) -> list[Chunk]:
    """Chunks of one book: leaves by topic, then chapter; excluded ones dropped; merged, split or kept; in line order."""
    groups: dict[tuple, list[Leaf]] = {}
    for x in leaves:
        if x.role != "excluded":
            groups.setdefault((x.topic, x.chapter), []).append(x)
    out: list[Chunk] = []
    for members in groups.values():
        for g in group_small(members, least, most):
            if len(g) > 1:
                out.append(Chunk(g[0].start, g[-1].end, g[0].role, " / ".join(x.title for x in g), [x.id for x in g], "merged"))
            else:
                out += split_large(g[0], heads, target, most)
    return sorted(out, key=lambda c: (c.start, c.sources))


def chunk_plan(leaves: DataFrame, heads: DataFrame, **limits: int) -> DataFrame:
    """D9 for all books: book_id, start, end, role, title, how, sources. A book's leaves and headings are one row each."""
    packed = heads.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("heads"))
    leaf = F.struct(F.col("md_start").cast("long").alias("start"), "id", F.col("md_end").cast("long").alias("end"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("kind", "title", "topic", "chapter")))
    books = leaves.groupBy("book_id").agg(F.array_sort(F.collect_list(leaf)).alias("leaves")).join(packed, "book_id", "left")
    names = ["book_id", "start", "end", "role", "title", "how", "sources"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 4

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            rows = []
            for book, held, found in zip(*(p.column(c).to_pylist() for c in ("book_id", "leaves", "heads")), strict=True):
                own = [Leaf(x["id"], x["kind"], x["title"], x["start"], x["end"], role_of(x["title"]), x["topic"], x["chapter"]) for x in held]
                chunks = plan_book(own, [(h["line"], h["text"]) for h in found or []], **limits)
                rows += [(book, c.start, c.end, c.role, c.title, c.how, ",".join(c.sources)) for c in chunks]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    # Few bytes but much work per book: a fixed number of partitions, which AQE does not merge.
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return books.repartition(n, "book_id").mapInArrow(run, "book_id long, start long, end long, role string, title string, how string, sources string")


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """D9 summary: per book smallest, largest and average size, counts by kind."""
    size = F.col("end") - F.col("start") + 1
    return chunks.groupBy("book_id").agg(F.min(size).alias("min"), F.max(size).alias("max"), F.floor(F.avg(size)).alias("avg"), *[F.count_if(F.col("how") == h).alias(h) for h in ("normal", "merged", "split")])


def interpolate_page(line: Column, md_start: Column, md_end: Column, page_start: Column, page_end: Column) -> Column:
    """The page of a line by proportion, halves upward; the first page if the item has no span."""
    share = (line - md_start) / F.nullif(md_end - md_start, F.lit(0))
    return F.coalesce(page_start + F.floor(share * (page_end - page_start) + 0.5), page_start).cast("int")


# --- tables of contents (D11, D12, D31) ----------------------------------------------------------------------------


def chinese_number(c: str | Column) -> Column:
    """Arabic digits or a Chinese numeral up to 99 as an integer; null otherwise."""
    v = F.regexp_replace(X.col(c), r"\s+", "")
    one = lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in DIGITS.items() for y in kv]), x)
    left, right = F.split_part(v, F.lit("十"), F.lit(1)), F.split_part(v, F.lit("十"), F.lit(2))
    tens = F.when(left == "", F.lit(1)).otherwise(one(left)) * 10 + F.when(right == "", F.lit(0)).otherwise(one(right))
    return F.when(v.rlike("^[0-9]+$"), F.try_to_number(v, F.lit("999999")).cast("int")).when(F.contains(v, F.lit("十")), tens).otherwise(one(v))


def toc_entries(toc: DataFrame) -> DataFrame:
    """Entries of contents lines (book_id, line, text): kind, order path, title, page; lessons take the chapter above.

    The chapter is carried forward by one window per book.
    """
    t = F.trim("text")
    head, page = (F.regexp_extract(t, TOC_LEADER, i) for i in (1, 2))
    plain, plain_page = (F.regexp_extract(t, TOC_CHAPTER, i) for i in (1, 2))
    e = toc.withColumn("head", F.trim(F.regexp_replace(F.when(page != "", head).otherwise(plain), r"[·•\s]+", " ")))
    e = e.withColumn("page", F.when(page != "", page).otherwise(plain_page)).where("page <> '' AND head <> ''").withColumn("page", F.col("page").cast("int"))
    chapter, section, dotted = CHAPTER, SECTION, DOTTED
    kind = (
        F.when(F.col("head").rlike(chapter), "theme").when(F.col("head").rlike(section), "lesson").when(F.col("head").rlike(APPENDIX), "boundary")
        .when(F.col("head").rlike(BOUNDARY), "boundary").when(F.col("head").rlike(dotted), "lesson")
    )
    e = e.withColumn("kind", kind).where("kind is not null")
    number = F.when(F.col("kind") == "theme", chinese_number(F.regexp_extract("head", chapter, 1)).cast("string"))
    w = Window.partitionBy("book_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("theme", F.last(number, ignorenulls=True).over(w))
    own = F.when(F.col("head").rlike(section), F.concat_ws(".", "theme", chinese_number(F.regexp_extract("head", section, 1)).cast("string"))).when(F.col("head").rlike(dotted), F.regexp_extract("head", dotted, 1))
    title = F.coalesce(*[F.when(F.col("head").rlike(p), F.trim(F.regexp_extract("head", p, 2))) for p in (chapter, section, dotted)], F.col("head"))
    return e.select("book_id", "line", "kind", F.coalesce(own, "theme").alias("order_path"), title.alias("title"), "page")


def next_start(items: DataFrame, level: str, start: str, order: str) -> Column:
    """The start of the next row of a book (in ``order``) with the same or a smaller level; null if none follows.

    The rows run backwards, so the frame of each expression grows from its begin and is never computed anew; one expression
    for each level that occurs.
    """
    deepest = items.agg(F.max(level)).first()[0]
    w = Window.partitionBy("book_id").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    levels = range((deepest if deepest is not None else 0) + 1)
    return F.coalesce(*[F.when(F.col(level) == k, F.last(F.when(F.col(level) <= k, F.col(start)), ignorenulls=True).over(w)) for k in levels])


def range_ends(items: DataFrame, start: str = "page", level: str = "level") -> DataFrame:
    """end = the start of the next entry of the same or a higher level, less one, at least the start; null if none follows."""
    nxt = next_start(items, level, start, "line")
    return items.withColumn("end", F.when(nxt.isNotNull(), F.greatest(F.col(start), nxt - 1)))


# --- heading trees and alignment (D13-D21) -------------------------------------------------------------------------


def heading_tree(heads: DataFrame) -> DataFrame:
    """Parents and order paths of headings: book_id, line, order_path, parent_line, depth, kind (theme, topic, lesson).

    The parent is the last heading before with a smaller level: six window functions, no stack.
    """
    w = Window.partitionBy("book_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") == k, F.last(F.when(F.col("level") < k, F.col("line")), ignorenulls=True).over(w)) for k in range(1, 7)]
    h = heads.withColumn("parent_line", F.coalesce(*above))
    sib = F.row_number().over(Window.partitionBy("book_id", "parent_line").orderBy("line"))
    h = h.withColumn("number", sib)
    up = h.select("book_id", F.col("line").alias("id"), F.col("parent_line").alias("parent_id"), F.col("number").alias("pos"))
    a = ancestors(up).join(h.select("book_id", F.col("line").alias("ancestor"), F.col("number").alias("n")), ["book_id", "ancestor"])
    path = a.groupBy("book_id", F.col("id").alias("line")).agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "n")))["n"].alias("up"))
    h = h.join(path, ["book_id", "line"], "left").withColumn("path", F.concat(F.coalesce("up", F.array().cast("array<int>")), F.array("number")))
    parents = h.select("book_id", F.col("parent_line").alias("line")).where("line is not null").distinct().withColumn("has", F.lit(True))
    h = h.join(parents, ["book_id", "line"], "left")
    kind = F.when(F.col("has").isNull(), "lesson").when(F.size("path") == 1, "theme").otherwise("topic")
    return h.select("book_id", "line", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("order_path"), "parent_line", F.size("path").alias("depth"), kind.alias("kind"))


def heading_norm(c: str | Column) -> Column:
    """Lower case, no images, markup and punctuation, no white space."""
    s = F.regexp_replace(F.lower(X.col(c)), IMAGE, " ")
    return F.regexp_replace(F.regexp_replace(s, HEADING_NOISE, " "), r"\s+", "")


def section_tokens(c: str | Column) -> Column:
    """Section numbers in a heading: dotted numbers and chapter, section, lesson and unit marks."""
    v = F.regexp_replace(F.regexp_replace(X.col(c), "[．。]", "."), r"\s+", "")
    return F.array_distinct(F.concat(F.regexp_extract_all(v, F.lit(f"({SECTION_DOTS})"), 1), F.regexp_extract_all(v, F.lit(f"({SECTION_MARK})"), 1)))


def without_number(c: str | Column) -> Column:
    """A heading without its leading section number."""
    s = F.regexp_replace(X.col(c), r"^#{1,6}\s*", "")
    return F.trim(F.regexp_replace(s, LEADING_NUMBER, ""))


@lru_cache(1 << 16)
def _norm(s: str) -> str:
    return re.sub(r"\s+", "", re.sub(HEADING_NOISE, " ", re.sub(IMAGE, " ", s.lower())))


@lru_cache(1 << 16)
def _tokens(s: str) -> frozenset[str]:
    v = re.sub(r"\s+", "", re.sub("[．。]", ".", s))
    return frozenset((*re.findall(SECTION_DOTS, v), *re.findall(SECTION_MARK, v)))


@lru_cache(1 << 16)
def _bare(s: str) -> str:
    return _norm(re.sub(LEADING_NUMBER, "", re.sub(r"^\s*#{1,6}\s*", "", s)))


def _edit(a: str, b: str) -> int:
    """Edit distance, one machine-independent bit vector per character of b (Myers' algorithm on Python integers)."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(x | up)) & full, up & x
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        v = eq | down
        up, down = (less | ~(v | more)) & full, more & v
    return score


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else max(1 - _edit(a, b) / max(len(a), len(b)), dice(a, b))


def heading_match(title: str, label: str, level: int | None, raw: str, raw_level: int) -> tuple[float, str] | None:
    """Confidence and type of a match between an outline item and a heading; None below 0.5 or with other numbers."""
    t, lab, h = _norm(title), _norm(label), _norm(raw)
    if not t and not lab:
        return None
    if h in (t, _norm(label + title)):
        return 0.99, "exact"
    own, there = _tokens(title) | _tokens(label), _tokens(raw)
    shared, other = bool(own & there), bool(own and there and not own & there)
    if not other and t and (t in h or h in t) and (r := min(len(t), len(h)) / max(1, len(t), len(h))) >= 0.55:
        return round(0.88 + r * 0.08, 4), "containment"
    alike = _alike(_bare(raw) or h, _bare(title) or t)
    fit = 0.5 if level is None else max(0.0, 1 - abs(level - raw_level) * 0.25)
    if shared:
        return round(0.42 + 0.53 * alike + 0.05 * fit, 4), "number_and_title"
    if other and alike < 0.92:
        return None
    c = max(0.92 * alike + 0.08 * fit, 0.88 * _alike(h, lab) if lab else 0.0)
    return (round(c, 4), "fuzzy_title") if c >= 0.5 else None


def align(items: list[dict], heads: list[dict], accept: float = 0.55) -> list[tuple[str, int, float, str]]:
    """The monotonic matching of items to headings with the highest sum of 1 + confidence.

    Ties prefer leaving the item, then the heading, unmatched.
    """
    n, m = len(items), len(heads)
    score = [[heading_match(i["title"], i.get("label") or "", i.get("level"), h["text"], h["level"]) for h in heads] for i in items]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            v = best[i - 1][j]
            if best[i][j - 1] > v + 1e-9:
                v = best[i][j - 1]
            s = score[i - 1][j - 1]
            if s and s[0] >= accept and best[i - 1][j - 1] + 1 + s[0] > v + 1e-9:
                v = best[i - 1][j - 1] + 1 + s[0]
            best[i][j] = v
    out, i, j = [], n, m
    while i and j:
        if abs(best[i][j] - best[i - 1][j]) <= 1e-9:
            i -= 1
        elif abs(best[i][j] - best[i][j - 1]) <= 1e-9:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((items[i]["id"], heads[j]["line"], *score[i][j]))
    return out[::-1]


def align_between(items: list[dict], heads: list[dict]) -> list[tuple[str, int, float, str]]:
    """Items with a ``fixed`` line keep it where such lines rise; the runs between them are aligned to the headings between."""
    out: list[tuple[str, int, float, str]] = []
    run, low = [], 0

    def settle(high: float) -> None:
        out.extend(align(run, [h for h in heads if low < h["line"] < high]))
        run.clear()

    for i in items:
        line = i.get("fixed")
        if line is None or line <= low:
            run.append(i)
            continue
        settle(line)
        out.append((i["id"], line, 1.0, i["fixed_by"]))
        low = line
    settle(float("inf"))
    return out


def marks(markdown: DataFrame) -> DataFrame:
    """book_id, id, line of the start marks in a markdown text; of repeated marks the last one counts."""
    m = lines(markdown).select("book_id", "line", F.regexp_extract("text", LESSON_START, 1).alias("id")).where("id <> ''")
    return m.groupBy("book_id", "id").agg(F.max("line").alias("line"))


def fixed_lines(items: DataFrame, markdown: DataFrame) -> DataFrame:
    """``items`` with fixed and fixed_by: the line of an existing range (md_start and md_end), else of a start mark."""
    own = F.when(F.col("md_start").isNotNull() & F.col("md_end").isNotNull(), F.col("md_start").cast("long"))
    j = items.join(marks(markdown).withColumnRenamed("line", "_mark"), ["book_id", "id"], "left")
    by = F.when(own.isNotNull(), "existing").when(F.col("_mark").isNotNull(), "marker")
    return j.withColumn("fixed_by", by).withColumn("fixed", F.coalesce(own, F.col("_mark").cast("long"))).drop("_mark")


def align_outlines(items: DataFrame, heads: DataFrame) -> DataFrame:
    """book_id, id, line, confidence, match_type, status (matched, warning, unmatched): one row per book inside.

    ``items`` may hold ``fixed`` lines (see ``fixed_lines``); those of an item without one come from the alignment.
    """
    known = [c for c in ("fixed", "fixed_by") if c in items.columns]
    a = items.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "id", "title", "label", "level", *known)))).alias("items"))
    b = heads.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "text", "level")))).alias("heads"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for book, x, y in zip(p["book_id"], p["items"], p["heads"], strict=True):
                its = json.loads(x)
                found = {r[0]: r[1:] for r in align_between(its, json.loads(y) if y else [])}
                for i in its:
                    line, conf, kind = found.get(i["id"], (None, 0.0, None))
                    rows.append((book, i["id"], line, conf, kind, "unmatched" if line is None else "matched" if conf >= 0.85 else "warning"))
            yield pd.DataFrame(rows, columns=["book_id", "id", "line", "confidence", "match_type", "status"]).astype({"line": "Int64"})

    # Few bytes but much work per book: a fixed number of partitions, which AQE does not merge.
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.join(b, "book_id", "left").select("book_id", "items", "heads").repartition(n, "book_id").mapInPandas(run, "book_id long, id string, line long, confidence double, match_type string, status string")


def parent_starts(items: DataFrame) -> DataFrame:
    """Items without a start take the smallest start of their descendants."""
    a = ancestors(items).join(items.where("md_start is not null").select("book_id", "id", "md_start"), ["book_id", "id"])
    low = a.groupBy("book_id", F.col("ancestor").alias("id")).agg(F.min("md_start").alias("low"))
    return items.join(low, ["book_id", "id"], "left").withColumn("md_start", F.coalesce("md_start", "low")).drop("low")


def hierarchical_ends(items: DataFrame, last: DataFrame) -> DataFrame:
    """end = start of the next item in order that is no descendant, less one; else the book's last line (book_id, last).

    Items in depth-first order: the next non-descendant is the next one of the same or a smaller depth.
    """
    nxt = next_start(items, "depth", "md_start", "pos")
    j = items.withColumn("nxt", nxt).join(last, "book_id", "left")
    return j.withColumn("md_end", F.greatest("md_start", F.coalesce(F.col("nxt") - 1, "last"))).drop("nxt", "last")


def combine_split_headings(heads: DataFrame, gap: int = 3) -> DataFrame:
    """A heading that is only a section number joins the next one if that follows within ``gap`` lines and has no number."""
    w = Window.partitionBy("book_id").orderBy("line")
    only = F.regexp_replace(F.col("text"), r"\s+", "").rlike(NUMBER_ONLY)
    h = heads.withColumn("only", only).withColumn("next_line", F.lead("line").over(w)).withColumn("next_text", F.lead("text").over(w)).withColumn("next_only", F.lead(only).over(w))
    pair = F.coalesce(F.col("only") & ~F.col("next_only") & (F.col("next_line") - F.col("line") <= gap), F.lit(False))
    h = h.withColumn("pair", pair).withColumn("eaten", F.coalesce(F.lag("pair").over(w), F.lit(False)))
    return h.where("not eaten").select("book_id", "line", "level", F.when(F.col("pair"), F.concat_ws(" ", "text", "next_text")).otherwise(F.col("text")).alias("text"))


def body_headings(heads: DataFrame) -> DataFrame:
    """Headings after the table of contents and before the appendix."""
    toc = heads.where(F.lower("text").rlike(CONTENTS_HEADING)).groupBy("book_id").agg(F.min("line").alias("toc"))
    app = heads.where(F.lower("text").rlike(APPENDIX_HEADING)).groupBy("book_id").agg(F.max("line").alias("app"))
    j = heads.join(toc, "book_id", "left").join(app, "book_id", "left")
    return j.where("line > coalesce(toc, 0) AND line < coalesce(app, 2147483647)").select(*heads.columns)


# --- previews, hints, lessons (D22-D40) ----------------------------------------------------------------------------


def fingerprint(items: DataFrame) -> DataFrame:
    """Per book the sha256 over its items as JSON, in id order."""
    return items.groupBy("book_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("id", *[c for c in items.columns if c not in ("id", "book_id")])))), 256).alias("fingerprint"))


def preview(items: DataFrame) -> DataFrame:
    """Items in depth-first order (path) with alignment flags and per-kind counts of their book."""
    counts = items.groupBy("book_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("theme", "topic", "lesson")])
    flag = F.col("status").isin("warning", "unmatched")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("path"))
    return items.withColumn("place", place).withColumn("needs_review", flag).join(counts, "book_id")


def chunk_previews(chunks: DataFrame, markdown: DataFrame, chars: int = 360) -> DataFrame:
    """The first characters of a chunk's lines, images as a mark, white space collapsed."""
    held = chunks.withColumn("_chunk", F.struct(*chunks.columns))
    part = held.select("book_id", "_chunk").join(lines(markdown), "book_id").where("line BETWEEN _chunk.start AND _chunk.end")
    cut = F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "\n")
    got = part.groupBy("_chunk").agg(cut.alias("cut")).select("_chunk.*", F.trim(F.regexp_replace(F.regexp_replace("cut", IMAGE, "[image]"), r"\s+", " ")).alias("cut"))
    return got.select(*chunks.columns, F.substring("cut", 1, chars).alias("preview"))


#: Rows of a table and hints of a text that are shown.
TABLE_ROWS, HINTS = 12, 20


def hints(markdown: DataFrame, most: int = HINTS) -> DataFrame:
    """Tables (two or more pipe rows), equations (block or inline) and images: book_id, position, modality, locator, excerpt.

    Lines are classified, and windows over a book find the blocks: a line that starts with two dollar signs opens a block or
    ends the open one, so whether a line lies inside follows from the number of such lines since the last that is closed in
    itself, which always ends outside. Runs of table rows are neighbours of one difference between line and row number.
    A hint stands where it ends; the position counts them, and the first ``most`` of a book stay.
    """
    book = Window.partitionBy("book_id").orderBy("line")
    since = Window.partitionBy("book_id", "lap").orderBy("line")
    t = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    x = lines(markdown).select("book_id", "line", t.alias("text"))
    fence = F.startswith("text", F.lit("$$"))
    closed = fence & (F.char_length("text") > 2) & F.endswith("text", F.lit("$$"))
    x = x.withColumn("fence", fence).withColumn("closed", closed).withColumn("lap", F.sum(F.col("closed").cast("int")).over(book))
    x = x.withColumn("open", F.sum((F.col("fence") & ~F.col("closed")).cast("int")).over(since) % 2 == 1)
    x = x.withColumn("inside", F.coalesce(F.lag("open").over(book), F.lit(False)))
    x = x.withColumn("block", F.sum((F.col("open") & ~F.col("inside")).cast("int")).over(book))
    free, inline, image = ~F.col("inside"), F.col("text").rlike(r"(?<!\$)\$[^$]+\$(?!\$)"), F.col("text").rlike(IMAGE)
    kind = F.when(F.col("closed") | (inline & ~F.col("fence")), "equation").when(F.col("fence"), None).when(image, "image")
    single = x.where(free).select("book_id", "line", F.lit(1).alias("after"), kind.alias("modality"), F.concat(F.lit("line:"), "line").alias("locator"), F.col("text").alias("excerpt")).where("modality IS NOT NULL")
    whole = x.where((F.col("inside") & (F.col("text") != "")) | (F.col("open") & free)).groupBy("book_id", "block").agg(
        F.max("line").alias("line"), F.max(F.col("inside") & F.col("fence")).alias("ended"), F.array_join(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], "\n").alias("excerpt")
    )
    place = F.when(F.col("ended"), F.concat(F.lit("line:"), "line")).otherwise("markdown-equation-unclosed")
    whole = whole.select("book_id", F.when(F.col("ended"), F.col("line")).otherwise(1 << 30).alias("line"), F.lit(2).alias("after"), F.lit("equation").alias("modality"), place.alias("locator"), "excerpt")
    row = free & ~F.col("fence") & ~inline & ~image & F.startswith("text", F.lit("|")) & F.endswith("text", F.lit("|"))
    rows = x.where(row).withColumn("run", F.col("line") - F.row_number().over(book))
    shown = F.array_join(F.slice(F.array_sort(F.collect_list(F.struct("line", "text")))["text"], 1, TABLE_ROWS), "\n")
    table = rows.groupBy("book_id", "run").agg(F.max("line").alias("line"), F.count("*").alias("n"), shown.alias("excerpt")).where("n > 1")
    table = table.select("book_id", (F.col("line") + 1).alias("line"), F.lit(0).alias("after"), F.lit("table").alias("modality"), F.lit(None).cast("string").alias("locator"), "excerpt")
    every = single.unionByName(whole).unionByName(table).withColumn("position", F.row_number().over(Window.partitionBy("book_id").orderBy("line", "after")) - 1).where(F.col("position") < most)
    return every.select("book_id", "position", "modality", F.coalesce("locator", F.concat(F.lit("markdown-table-"), F.col("position") + 1)).alias("locator"), "excerpt")


def retrieval_queries(markdown: DataFrame, titles: DataFrame, limit: int = 6) -> DataFrame:
    """Title, headings and short lines without a sentence end, in order, each once, at most ``limit`` per book."""
    t = F.trim("text")
    ok = (t != "") & ~F.startswith(t, F.lit("!")) & ~F.startswith(t, F.lit("|")) & (F.startswith(t, F.lit("#")) | ((F.char_length(t) <= 40) & ~t.rlike(r"[。.!?？]$")))
    q = lines(markdown).where(ok).select("book_id", "line", F.trim(F.regexp_replace(t, "^#+", "")).alias("q"))
    q = titles.select("book_id", F.lit(0).alias("line"), F.trim("title").alias("q")).unionByName(q).where("q <> ''")
    first = q.groupBy("book_id", "q").agg(F.min("line").alias("line"))
    r = first.withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy("line", "q"))).where(F.col("rank") <= limit)
    return r.select("book_id", "rank", F.col("q").alias("query"))


def search_text(c: str | Column) -> Column:
    """Letters and digits only, lower case, without images and tags."""
    s = F.regexp_replace(F.regexp_replace(X.col(c), IMAGE, " "), r"<[^>]+>", " ")
    return F.lower(F.regexp_replace(s, r"[\s\p{P}\p{S}]+", ""))


def match_evidence(blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """The best block of an evidence row inside its book: asset name 1.0, mutual containment up to .99, 64-character prefix .72,
    page .35, else none. blocks: book_id, page_index, block_id, text, image_path; evidence: book_id, id, excerpt, asset, page_start.
    """
    base = lambda c: F.lower(F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/"), -1))
    e = evidence.withColumn("q", search_text("excerpt")).withColumn("asset_name", base(F.coalesce("asset", F.lit(""))))
    b = blocks.withColumn("c", search_text("text")).withColumn("image_name", base(F.coalesce("image_path", F.lit(""))))
    j = e.join(b, "book_id", "left")
    inside = F.contains("c", F.col("q")) | F.contains("q", F.col("c"))
    long_enough = (F.char_length("q") >= 6) & (F.char_length("c") >= 4)
    ratio = F.least(F.char_length("q"), F.char_length("c")) / F.greatest(F.char_length("q"), F.char_length("c"))
    prefix = (F.char_length("q") >= 12) & F.contains("c", F.substring("q", 1, 64))
    s = (
        F.when((F.col("asset_name") != "") & (F.col("asset_name") == F.col("image_name")), 1.0).when(long_enough & inside, F.least(F.lit(0.99), ratio + 0.5))
        .when(long_enough & prefix, 0.72).when(F.col("page_start") - 1 == F.col("page_index"), 0.35).otherwise(0.0)
    )
    kind = F.when(F.col("s") == 1, "asset").when(F.col("s") > 0.35, "text").when(F.col("s") == 0.35, "page").otherwise("none")
    best = j.withColumn("s", s).groupBy("book_id", "id").agg(F.min(F.struct((-F.col("s")).alias("neg"), "page_index", "block_id")).alias("m"))
    best = best.select("book_id", "id", (-F.col("m.neg")).alias("s"), F.col("m.page_index").alias("page_index"), F.col("m.block_id").alias("block_id"))
    some = F.col("s") > 0
    return best.select("book_id", "id", F.round("s", 2).alias("confidence"), kind.alias("kind"), F.when(some, F.col("page_index")).alias("page_index"), F.when(F.col("s") > 0.35, F.col("block_id")).alias("block_id"))


def flatten_tree(tree: str | None) -> list[tuple[str, str, str, int]]:
    """Depth-first rows (title, title path, order path, children) of nested JSON nodes with ``child_nodes``."""
    out: list[tuple[str, str, str, int]] = []
    held = json.loads(tree) if tree else []
    walk = [(n, [], [i]) for i, n in reversed(list(enumerate(held if isinstance(held, list) else [held], 1)))]
    while walk:
        node, up, order = walk.pop()
        title, kids = str(node.get("title") or "").strip(), node.get("child_nodes") or []
        out.append((title, " / ".join([*up, title]), ".".join(map(str, order)), len(kids)))
        walk += [(k, [*up, title], [*order, i]) for i, k in reversed(list(enumerate(kids, 1)))]
    return out


def tree_rows(books: DataFrame) -> DataFrame:
    """D29, D30 for a table of trees: path, title, title_path, order_path, n_children."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(b, *r) for b, t in zip(p["path"], p["tree_json"], strict=True) for r in flatten_tree(t)], columns=["path", "title", "title_path", "order_path", "n_children"])

    return books.select("path", "tree_json").mapInPandas(run, "path string, title string, title_path string, order_path string, n_children int")


def map_headings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Headings of a scan (book_id, line, text) to markdown headings of the same normal form, in order: the k-th to the k-th."""
    w = Window.partitionBy("book_id", "norm").orderBy("line")
    a, b = (df.withColumn("norm", heading_norm("text")).withColumn("k", F.row_number().over(w)).select("book_id", "norm", "k", F.col("line").alias(n)) for df, n in ((left, "scan_line"), (right, "line")))
    return a.join(b, ["book_id", "norm", "k"]).select("book_id", "scan_line", "line")


def outline_source(books: DataFrame, enrich: DataFrame, aligned: DataFrame) -> DataFrame:
    """Per book the outline to use: the enrich tree if it has rows, else markdown headings, else none."""
    e = enrich.groupBy("book_id").agg(F.count("*").alias("n_enrich"))
    m = aligned.groupBy("book_id").agg(F.count("*").alias("n_markdown"))
    j = books.join(e, "book_id", "left").join(m, "book_id", "left")
    return j.select("book_id", F.when(F.col("n_enrich") > 0, "enrich").when(F.col("n_markdown") > 0, "markdown").otherwise("none").alias("source"))


def uncovered_leaves(leaves: DataFrame, chunks: DataFrame) -> DataFrame:
    """Leaves that no chunk names as a source (a book with any is chunked anew)."""
    s = chunks.select("book_id", F.explode(F.split("sources", ",")).alias("id"))
    return leaves.where(X.content_role("title") != "excluded").join(s, ["book_id", "id"], "left_anti")


def lessons(markdown: DataFrame) -> DataFrame:
    """Lessons of raw markdown: lesson-like headings, else the first 20 of level one or two; end = next start - 1; a preview.

    One window per book; whether a book has lesson-like headings is a window aggregate.
    """
    like = F.col("text").rlike(LESSON_TITLE) | F.col("text").rlike(LESSON_NUMBER)
    h = headings(markdown).withColumn("like", like)
    by = Window.partitionBy("book_id")
    h = h.withColumn("any_like", F.max("like").over(by)).where("like OR (NOT any_like AND level <= 2)")
    h = h.withColumn("k", F.row_number().over(by.orderBy("line"))).where("any_like OR k <= 20")
    n = markdown.select("book_id", F.split("md", "\n").alias("ls"))
    h = h.withColumn("next", F.lead("line").over(by.orderBy("line"))).join(n, "book_id")
    end = F.greatest("line", F.coalesce("next", F.size("ls") + 1) - 1)
    body = F.transform(F.slice("ls", F.col("line"), end - F.col("line") + 1), lambda x: F.trim(F.regexp_replace(x, r"^#{1,6}\s+", "")))
    body = F.slice(F.filter(body, lambda x: (x != "") & ~x.rlike(r"^!\[[^\]]*\]\(")), 1, 4)
    return h.select("book_id", F.col("line").alias("md_start"), end.alias("md_end"), F.col("text").alias("title"), F.substring(F.array_join(body, " "), 1, 180).alias("preview"))


def book_titles(markdown: DataFrame, toc: str = CONTENTS_LINE, keep: str = TITLE_KEEP, drop: str = TITLE_DROP, parts: int = 4) -> DataFrame:
    """A title from up to four distinct short lines before the contents (or among the first 90); else the book id."""
    ls = lines(markdown).withColumn("t", F.trim("text"))
    at = ls.where(F.col("t").rlike(toc)).groupBy("book_id").agg(F.min("line").alias("toc"))
    ls = ls.join(at, "book_id", "left").where(F.col("line") < F.coalesce("toc", F.lit(91)))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"^#{1,6}\s+", ""), TITLE_CAPITALS, ""), r"\s+", " "))
    c = ls.select("book_id", "line", t.alias("t")).where((F.col("t") != "") & (F.char_length("t") <= 32) & ~F.col("t").rlike(drop) & F.col("t").rlike(keep))
    c = c.groupBy("book_id", "t").agg(F.min("line").alias("line")).withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("line"))).where(F.col("k") <= parts)
    c = c.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "t")))["t"], " ").alias("title"))
    return markdown.select("book_id").join(c, "book_id", "left").withColumn("title", F.coalesce("title", F.col("book_id").cast("string")))


def heading_paths(markdown: DataFrame, at: DataFrame, context: int = 2) -> DataFrame:
    """For lines (book_id, line) the path of headings above and ``context`` lines around, by windows over the book's lines."""
    ls = lines(markdown).withColumn("level", F.char_length(F.regexp_extract("text", r"^(#{1,6})\s", 1)))
    w = Window.partitionBy("book_id").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 4):
        ls = ls.withColumn(f"l{k}", F.last(F.when(F.col("level") == k, F.col("line")), ignorenulls=True).over(upto)).withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.trim(F.regexp_replace("text", r"^#+\s+", ""))), ignorenulls=True).over(upto))
    # A deeper heading counts only if it stands below the last higher one.
    t2 = F.when(F.col("l2") > F.coalesce("l1", F.lit(0)), F.col("t2"))
    t3 = F.when(F.col("l3") > F.greatest(F.coalesce("l1", F.lit(0)), F.coalesce("l2", F.lit(0))), F.col("t3"))
    near = F.array_join(F.filter(F.collect_list("text").over(w.rowsBetween(-context, context)), lambda x: F.trim(x) != ""), "\n")
    ls = ls.withColumn("path", F.concat_ws(" > ", "t1", t2, t3)).withColumn("near", near)
    return at.join(ls.select("book_id", "line", "path", "near"), ["book_id", "line"])


def image_paths(evidence: DataFrame) -> DataFrame:
    """The image path of an evidence row: its own path, markup in locator or excerpt, or a bare file name in the excerpt."""
    mark = r"!\[[^\]]*\]\(([^)\s]+)"
    bare = r"([\w./-]+\.(?:png|jpe?g|gif|webp|svg))"
    filled = lambda c: F.when(c != "", c)
    found = F.coalesce(filled(F.trim("path")), *[filled(F.regexp_extract(c, p, 1)) for p in (mark, bare) for c in ("locator", "excerpt")])
    return evidence.withColumn("image_path", found)


def filter_tree(items: DataFrame, term: str) -> DataFrame:
    """Items whose title holds the term (case-insensitive), with all their ancestors."""
    hit = items.where(F.contains(F.lower("title"), F.lit(term.lower()))).select("book_id", "id")
    up = ancestors(items).join(hit, ["book_id", "id"], "left_semi").select("book_id", F.col("ancestor").alias("id"))
    return items.join(hit.union(up).distinct(), ["book_id", "id"], "left_semi")


def page_window(active: Column, n_pages: Column, radius: int = 2) -> Column:
    """Pages around the active one, inside the book."""
    return F.sequence(F.greatest(active - radius, F.lit(0)), F.least(active + radius, n_pages - 1))


def nearest_page(pages: DataFrame, position: float) -> DataFrame:
    """Per book the page whose centre is nearest to a scroll position (ties: the first page)."""
    d = F.abs((F.col("top") + F.col("bottom")) / 2 - F.lit(position))
    return pages.groupBy("book_id").agg(F.min(F.struct(d.alias("d"), "page")).alias("m")).select("book_id", F.col("m.page").alias("page"))


