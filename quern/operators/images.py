"""Image references of evidence rows, recovered from the text they came from.

A row's own path counts if it is a URL or a known asset. Else its line in the book is sought, the first hit of this cascade:

1. the first line that holds its path, the path decoded, or the file name alone (also of image markup in the excerpt);
2. the first line that holds the excerpt (8 characters or more), both cleaned;
3. the first line that holds a fragment of the excerpt (12 characters or more), fragments in order;
4. the line that the locator names.

The image of that line is the nearest image line at or before it, else the nearest after it, at most ``WINDOW`` lines away.

A book is one text, and all its evidence rows meet it at once: both are moved once, by the book, and nothing else is. In the book
no row passes over all lines: a needle is sought from the start of the text as far as its first hit, and in a long text only
at the places of its rarest gram (``Lines``).

evidence: book_id, id, path, locator, excerpt (nulls count as empty); markdown: book_id, md; assets: book_id, path.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines to the nearest image, characters of a gram, and of a text that is read from its start for every needle.
WINDOW, GRAM, SMALL = 16, 8, 1 << 16
SHORTEST_EXCERPT, SHORTEST_FRAGMENT, FRAGMENT = 8, 12, 80
#: Image markup, image file names, and the mark that stands for an image in cleaned text.
MARKDOWN_IMAGE, HTML_IMAGE = r"!\[[^\]]*\]\(([^)\n]+)\)", r"""(?i)<img\b[^>]*\bsrc=["']([^"']+)["'][^>]*>"""
IMAGE_NAME, URL = r"(?i)\.(png|jpe?g|webp|gif|bmp|svg)(\?.*)?$", "(?i)^https?://"
MARK = "图片"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def markup_path(c: Column) -> Column:
    """The path of the first markdown image, else of the first image tag, else the empty text."""
    found = lambda sign, pattern: F.when(F.contains(c, F.lit(sign)), strip(F.regexp_extract(c, pattern, 1)))  # noqa: E731  most texts have none
    return first_filled(found("![", MARKDOWN_IMAGE), found("<", HTML_IMAGE))


def image_like(c: Column) -> Column:
    return first_filled(markup_path(c), F.when(c.rlike(IMAGE_NAME), c).otherwise(""))


def clean_line(c: Column) -> Column:
    """Images as ``[图片：label]`` (their text, else their file name), without heading marks, white space collapsed."""
    marked = F.regexp_replace(c, r"!\[\s*\]\(\s*(?:[^)]*/)?([^)/]+?)/*\s*\)", f"[{MARK}：$1]")
    marked = F.regexp_replace(marked, r"!\[\s*([^\]]*?)\s*\]\([^)]+\)", f"[{MARK}：$1]")
    marked = F.regexp_replace(marked, r"""(?i)<img\b[^>]*\bsrc=["']\s*(?:[^"']*/)?([^"'/]+?)/*\s*["'][^>]*>""", f"[{MARK}：$1]")
    marked = F.regexp_replace(marked, r"^#{1,6}\s+", "")
    c = F.when(F.contains(c, F.lit("![")) | F.contains(c, F.lit("<")) | F.startswith(c, F.lit("#")), marked).otherwise(c)
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"\\", "/"), "([^/]+)/*$", 1)


def _paths(raw_path: Column, excerpt: Column) -> Column:
    """What to look for first, in raw lines: the row's path and that of image markup in its excerpt, each also decoded and as a file name."""
    both = F.filter(F.array(raw_path, markup_path(excerpt)), lambda p: p != "")
    return F.filter(F.array_distinct(F.flatten(F.transform(both, lambda p: F.array(p, F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p), base_name(p))))), lambda p: p != "")


def _parts(excerpt: Column) -> Column:
    """The fragments of a cleaned excerpt, in order."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(excerpt, rf"\[{MARK}：[^\]]+\]", " "), " +", " "))
    plain = F.when(F.contains(excerpt, F.lit(MARK)), bare).otherwise(excerpt)
    parts = F.filter(F.transform(F.concat(F.split(plain, "[。！？；]"), F.array(plain)), lambda s: F.trim(s)), lambda s: F.char_length(s) >= SHORTEST_FRAGMENT)
    return F.array_distinct(F.transform(parts, lambda s: F.substring(s, 1, FRAGMENT)))


class Lines:
    """The lines of a book, to find the first that holds a needle.

    A text of over ``small`` characters has the places of its grams in order of their hashes. The places of the needle's
    rarest gram come in order, so the first that shows the whole needle is its first hit. A gram is as long as the needle
    where that has under ``GRAM`` characters.
    """

    def __init__(self, lines: Sequence[str], small: int = SMALL):
        self.text = "\n".join(lines)
        self.starts = list(accumulate((len(x) + 1 for x in lines[:-1]), initial=0)) if lines else []
        self.small = small
        self.first, self._grams = lru_cache(None)(self._first), lru_cache(None)(self._sorted)

    @staticmethod
    def _hashes(text: str, k: int) -> np.ndarray:
        x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        h = np.zeros(max(0, len(x) - k + 1), np.uint32)
        for i in range(k):
            h = h * np.uint32(1_000_003) + x[i : i + len(h)]
        return h

    def _sorted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes(self.text, k)
        order = np.argsort(h, kind="stable")
        return h[order], order

    def _place(self, needle: str) -> int:
        if len(self.text) <= self.small:
            return self.text.find(needle)
        held, order = self._grams(k := min(len(needle), GRAM))
        grams = self._hashes(needle, k)
        low, high = np.searchsorted(held, grams), np.searchsorted(held, grams, "right")
        i = int((high - low).argmin())
        return next((at for p in order[low[i] : high[i]] if (at := int(p) - i) >= 0 and self.text.startswith(needle, at)), -1)

    def _first(self, needle: str) -> int | None:
        """The number (from 1) of the first line that holds the needle."""
        at = -1 if "\n" in needle or not needle else self._place(needle)
        return bisect_right(self.starts, at) if at >= 0 else None


def _placer(window: int):
    """Per book: for each row the line it is sought at and the path of the image nearest to that line."""

    @F.arrow_udf("array<struct<line:int,path:string>>")
    def place(lines: pa.Array, cleaned: pa.Array, images: pa.Array, paths: pa.Array, excerpts: pa.Array, parts: pa.Array, said: pa.Array) -> pa.Array:
        out = []
        for b in range(len(lines)):
            raw, clean, path = Lines(lines[b].as_py() or []), Lines(cleaned[b].as_py() or []), images[b].as_py() or []
            shown = [n for n, p in enumerate(path, 1) if p]
            named, sought, told = paths[b].as_py(), excerpts[b].as_py(), said[b].as_py()
            got = []
            for i, excerpt in enumerate(sought):
                if excerpt is None:  # its own path counts
                    got.append((None, None))
                    continue
                at = min((n for p in named[i] if (n := raw.first(p))), default=None)
                if at is None and len(excerpt) >= SHORTEST_EXCERPT:
                    at = clean.first(excerpt) or next((n for s in parts[b].values[i].as_py() if (n := clean.first(s))), None)
                at = told[i] if at is None else at
                if at is None or not 1 <= at <= len(path):
                    got.append((None, None))
                    continue
                k = bisect_right(shown, at)
                near = shown[k - 1] if k and at - shown[k - 1] <= window else shown[k] if k < len(shown) and shown[k] - at <= window else None
                got.append((at, path[near - 1] if near else None))
            out.append([{"line": n, "path": p} for n, p in got])
        return pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("path", pa.string())])))

    return place


def recover_images(evidence: DataFrame, markdown: DataFrame, assets: DataFrame, window: int = WINDOW) -> DataFrame:
    """``evidence`` with raw_path, source_line (where it was sought and found) and image_path (null if there is none)."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("path", "locator", "excerpt")}
    rows = evidence.withColumns(text).withColumn("raw_path", first_filled(strip(F.col("path")), image_like(F.col("locator")), image_like(F.col("excerpt"))))
    known = assets.select("book_id", F.col("path").alias("raw_path"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["book_id", "raw_path"], "left")
    fine = F.col("raw_path").rlike(URL) | F.coalesce("known", F.lit(False))
    rows = rows.withColumn("known", F.coalesce(fine, F.lit(False)))
    rest = rows.where("book_id IS NULL").withColumns({"source_line": F.lit(None).cast("int"), "image_path": F.when(F.col("known"), F.col("raw_path"))}).drop("known")
    opened = rows.where("book_id IS NOT NULL").groupBy("book_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "book_id"])).alias("row"))
    each = lambda f: F.transform("row", f)
    books = opened.join(markdown.select("book_id", F.split("md", "\n").alias("lines")), "book_id", "left")
    books = books.withColumns({"cleaned": F.transform("lines", clean_line), "images": F.transform("lines", markup_path), "excerpts": each(lambda r: F.when(~r["known"], clean_line(r["excerpt"])))})
    paths, said = each(lambda r: F.when(~r["known"], _paths(r["raw_path"], r["excerpt"]))), each(lambda r: F.regexp_extract(r["locator"], r"(?i)line:(\d+)", 1).try_cast("int"))
    books = books.withColumn("place", _placer(window)("lines", "cleaned", "images", paths, "excerpts", F.transform("excerpts", _parts), said))
    placed = books.select("book_id", F.explode(F.arrays_zip("row", "place")).alias("x")).select("book_id", "x.row.*", F.col("x.place.line").alias("source_line"), F.when(F.col("x.row.known"), F.col("x.row.raw_path")).otherwise(F.col("x.place.path")).alias("image_path")).drop("known")
    return placed.unionByName(rest)
