"""Layout: spans and rulings to blocks — reading order, lines, headings, lists, tables, running headers — and blocks to text, Markdown and HTML.

A block is a dict: kind (heading, paragraph, list, table), lines, and level, items or rows. A line has inlines (text, bold, italic), x, y, end_x and size.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate

from .content import Ruling, Span

#: Fixed values of the layout rules: distances in points or em, shares of a width or height, least numbers of spans and lines.
LINE, GLUE, PARAGRAPH, WORD_CELL = 0.5, 0.15, 1.8, 1.0
GAP, BINS, COLUMN_SPANS, COLUMN_LINES, SIDE_SPANS, NEAR = 6.0, 128, 40, 6, 10, 6.0
ACROSS, MIDDLE, SIDE_WIDTH, SIDE_HEIGHT = 0.5, (0.25, 0.75), 0.25, 0.4
HEAD_CHARS, TITLE_CHARS = 120, 60
_MARKER = re.compile(r"\s*(?:([•◦▪–\-*])|(\d{1,3})[.)])\s+")


@dataclass
class Line:
    inlines: list[tuple[str, bool, bool]]
    x: float
    y: float
    end_x: float
    size: float
    spans: list[Span] = field(default_factory=list)

    @property
    def text(self) -> str:
        return self.inlines[0][0] if len(self.inlines) == 1 else "".join([t for t, _, _ in self.inlines])


@dataclass
class Block:
    kind: str
    lines: list[Line]
    level: int = 0
    items: list[tuple[str, int | None, list[int]]] = field(default_factory=list)
    rows: list[list[tuple[Line | None, int]]] = field(default_factory=list)
    role: str | None = None

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        ls = self.lines or [c for r in self.rows for c, _ in r if c]
        return (min(x.x for x in ls), min(x.y for x in ls), max(x.end_x for x in ls), max(x.y + x.size for x in ls)) if ls else (0.0, 0.0, 0.0, 0.0)


def half_points(size: float) -> int:
    """The size in half points, halves away from zero."""
    return math.floor(size * 2 + 0.5)


def upper_median(v: list[float]) -> float:
    return sorted(v)[len(v) // 2] if v else 0.0


class Sizes:
    """The body size, which most characters have (the smaller of equals), and the larger sizes as a ladder of heading levels."""

    def __init__(self, spans):
        n: Counter = Counter()
        for s in spans:
            n[half_points(s[4])] += len("".join(s[0].split()))
        self.body = min(n, key=lambda k: (-n[k], k)) if n else 0
        self.ladder = sorted((k for k in n if k >= self.body + 2), reverse=True)

    def level(self, line: Line) -> int:
        if not self.ladder:
            return 0
        least = min((half_points(s.size) for s in line.spans), default=0)
        return min(6, self.ladder.index(least) + 1) if least in self.ladder else 0


# lines


def group_lines(spans: list[Span]) -> list[Line]:
    """First fit: a span joins the first group whose baseline is within half the larger size."""
    groups: list[list] = []
    # groups by baseline, in strips as high as a span can reach: only a strip and its neighbours can have a fit
    reach = LINE * max([s.size for s in spans]) if len(spans) > 8 else 0.0
    strips: dict[int, list[list]] | None = {} if 0 < reach < math.inf and all(abs(s.y) < 1e6 * reach for s in spans) else None
    for s in spans:
        text, _, y, _, size, *_ = s
        if not text:
            continue
        if strips is None:
            near = groups
        else:
            at = math.floor(y / reach)
            near = strips.get(at)
            near = [g for k in (at - 1, at, at + 1) for g in strips.get(k, ())] if near is None or at - 1 in strips or at + 1 in strips else near
        first = None
        for g in near:
            if abs(g[0] - y) <= LINE * (size if size > g[1] else g[1]) and (first is None or g[3] < first[3]):
                first = g
                if strips is None:
                    break
        if first is not None:
            first[2].append(s)
            first[1] = max(first[1], size)
        else:
            groups.append([y, size, [s], len(groups)])
            if strips is not None:
                strips.setdefault(at, []).append(groups[-1])
    groups.sort(key=lambda g: -g[0])
    return [x for g in groups if (x := assemble(g[2]))]


def assemble(spans: list[Span]) -> Line | None:
    """One line: a gap of over 0.15 of the size is a space; neighbours of one style join."""
    if len(spans) == 1:
        text, x, y, end, size, _, bold, italic = spans[0]
        return Line([(text, bold, italic)], x, y, end, size, [spans[0]]) if text.strip() else None
    spans = sorted(spans, key=lambda s: s.x)
    inlines: list[tuple[str, bool, bool]] = []
    end = None
    for s in spans:
        text = s.text
        if end is not None and s.x - end > GLUE * s.size and not text.startswith(" ") and not inlines[-1][0].endswith(" "):
            text = " " + text
        if inlines and inlines[-1][1:] == (s.bold, s.italic):
            inlines[-1] = (inlines[-1][0] + text, s.bold, s.italic)
        else:
            inlines.append((text, s.bold, s.italic))
        end = s.end_x if end is None else max(end, s.end_x)
    if not any(t.strip() for t, _, _ in inlines):
        return None
    return Line(inlines, min(s.x for s in spans), spans[0].y, end, max(s.size for s in spans), spans)


# reading order


def occupancy(lo: float, hi: float, extents: list[tuple[float, float]]) -> list[int]:
    """How many extents reach into each bin, by a running sum over where they begin and end."""
    step, edge = (hi - lo) / BINS or 1.0, [0] * (BINS + 1)
    for a, b in extents:
        first = max(0, math.floor((a - lo) / step))
        end = min(BINS, max(first + 1, math.ceil((b - lo) / step)))
        if first < end:
            edge[first] += 1
            edge[end] -= 1
    return list(accumulate(edge[:-1]))


def interior_gaps(bins: list[int], width: float, least: float = GAP) -> list[tuple[int, int]]:
    """Runs of empty bins that are wide enough and touch neither edge."""
    out, start = [], None
    for k, n in enumerate([*bins, 1]):
        if n == 0:
            start = k if start is None else start
        elif start is not None:
            if start > 0 and k < len(bins) and (k - start) * width >= least:
                out.append((start, k))
            start = None
    return out


def gutter(spans: list[Span], lo: float, hi: float) -> float | None:
    """Where the page's columns part: the only wide empty lane of a body that is taller than wide, in the middle, with a column on either side."""
    low, high = min(s.y for s in spans), max(s.y for s in spans)
    if len(spans) < COLUMN_SPANS or high - low <= hi - lo:
        return None
    step = (hi - lo) / BINS
    lanes = interior_gaps(occupancy(lo, hi, [(min(s.x, s.end_x), max(s.x, s.end_x)) for s in spans]), step)
    if len(lanes) != 1 or not MIDDLE[0] <= sum(lanes[0]) / 2 / BINS <= MIDDLE[1]:
        return None
    cut = lo + sum(lanes[0]) / 2 * step
    sides = [[s for s in spans if max(s.x, s.end_x) <= cut], [s for s in spans if max(s.x, s.end_x) > cut]]
    return cut if all(is_column(side, hi - lo, high - low) for side in sides) else None


def is_column(side: list[Span], width: float, height: float) -> bool:
    """Spans on several lines that take up enough of the page's text."""
    if len(side) < SIDE_SPANS or len({round(s.y) for s in side}) < COLUMN_LINES:
        return False
    x = [v for s in side for v in (s.x, s.end_x)]
    y = [s.y for s in side]
    return max(x) - min(x) >= SIDE_WIDTH * width and max(y) - min(y) >= SIDE_HEIGHT * height


def segments(spans: list[Span]) -> list[list[Span]]:
    """Spans in reading order: where a page has two columns, what stands above, the left, the right, and so on between the wide lines that cross both."""
    if len(spans) < COLUMN_SPANS:
        return [spans]
    lo, hi = min(min(s.x, s.end_x) for s in spans), max(max(s.x, s.end_x) for s in spans)
    wide = [abs(s.end_x - s.x) > ACROSS * (hi - lo) for s in spans]
    body = [s for s, w in zip(spans, wide, strict=True) if not w]
    cut = gutter(body, lo, hi) if body and math.isfinite(hi - lo) and hi > lo else None
    if cut is None:
        return [spans]
    crossing: dict[float, list[Span]] = defaultdict(list)
    for s, w in zip(spans, wide, strict=True):
        if w:
            crossing[s.y].append(s)
    edges = sorted(crossing, reverse=True)
    # bands from the top: a band takes what lies above its edge or on it
    bands: list[tuple[list[Span], list[Span]]] = [([], []) for _ in range(len(edges) + 1)]
    rising = [-y for y in edges]
    for s in body:
        bands[bisect_left(rising, -s.y)][max(s.x, s.end_x) > cut].append(s)
    out: list[list[Span]] = []
    for (left, right), y in zip(bands, [*edges, None], strict=True):
        out += [side for side in (left, right) if side]
        out += [crossing[y]] if y is not None else []
    return out


# tables


def cluster(rulings: list[Ruling]) -> tuple[list[tuple[float, float, float]], list[tuple[float, float, float]]]:
    """Horizontal (y, x0, x1) and vertical (x, y0, y1) lines: those within 6 points of a line belong to it, and extents that nearly meet are one."""

    def merge(lines):
        out: list[list] = []
        for pos, a, b in sorted(lines):
            if out and pos - out[-1][0] <= NEAR:
                out[-1][1].append((a, b))
            else:
                out.append([pos, [(a, b)]])
        done = []
        for pos, ext in out:
            ext.sort()
            cur = list(ext[0])
            for a, b in ext[1:]:
                if a <= cur[1] + NEAR:
                    cur[1] = max(cur[1], b)
                else:
                    done.append((pos, *cur))
                    cur = [a, b]
            done.append((pos, *cur))
        return done

    return merge([(r.y0, r.x0, r.x1) for r in rulings if abs(r.y1 - r.y0) <= abs(r.x1 - r.x0)]), merge([(r.x0, r.y0, r.y1) for r in rulings if abs(r.y1 - r.y0) > abs(r.x1 - r.x0)])


def crosses(h: tuple[float, float, float], v: tuple[float, float, float]) -> bool:
    """An L, T or + within tolerance."""
    return h[1] - NEAR <= v[0] <= h[2] + NEAR and v[1] - NEAR <= h[0] <= v[2] + NEAR


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def grids(rulings: list[Ruling]) -> list[tuple[list[float], list[float]]]:
    """(xs, ys falling) of lattices of crossing lines: at least 2 by 3."""
    hs, vs = cluster(rulings)
    u = Union(len(hs) + len(vs))
    for i, h in enumerate(hs):
        for j, v in enumerate(vs):
            if crosses(h, v):
                u.join(i, len(hs) + j)
    parts = defaultdict(lambda: (set(), set()))
    for i, h in enumerate(hs):
        parts[u.find(i)][1].add(h[0])
    for j, v in enumerate(vs):
        parts[u.find(len(hs) + j)][0].add(v[0])
    out = [(sorted(xs), sorted(ys, reverse=True)) for xs, ys in parts.values() if len(xs) >= 2 and len(ys) >= 3]
    return sorted(out, key=lambda g: -g[1][0])


def ruled_table(spans: list[Span], xs: list[float], ys: list[float]) -> tuple[Block | None, list[Span]]:
    """A table from the spans inside a lattice, and the other spans. A rule through a word means that this is no table."""
    inside = [s for s in spans if ys[-1] - 1 <= s.y <= ys[0] + 1 and xs[0] - NEAR <= s.x and s.end_x <= xs[-1] + NEAR]
    if not inside:
        return None, spans
    rows: list[list] = []
    for top, bottom in zip(ys, ys[1:], strict=False):
        band = [s for s in inside if bottom <= s.y < top]
        if not band:
            continue
        cells: list[list[Span]] = [[] for _ in range(len(xs) - 1)]
        for s in band:
            a = min(max(bisect_right(xs, s.x + 1) - 1, 0), len(cells) - 1)
            cells[a].append(s)
            if any(s.x + 1 < x < s.end_x - 1 for x in xs[1:-1]) and any(o is not s and abs(o.y - s.y) < 1 and 0 <= o.x - s.end_x < GLUE * s.size for o in band):
                return None, spans
        rows.append([(merged(group_lines(c)), 1) if c else (None, 1) for c in cells])
    if len(rows) < 2 or max(sum(c is not None for c, _ in r) for r in rows) < (1 if len(xs) == 2 else 2):
        return None, spans
    taken = {id(s) for s in inside}
    return Block("table", [], rows=rows), [s for s in spans if id(s) not in taken]


def merged(lines: list[Line]) -> Line | None:
    """A cell's lines as one, joined by spaces."""
    if not lines:
        return None
    inlines: list[tuple[str, bool, bool]] = []
    for k, x in enumerate(lines):
        for i, (t, b, it) in enumerate(x.inlines):
            t = " " + t.lstrip() if k and not i else t
            inlines = [*inlines[:-1], (inlines[-1][0] + t, b, it)] if inlines and inlines[-1][1:] == (b, it) else [*inlines, (t, b, it)]
    return Line(inlines, min(x.x for x in lines), lines[0].y, max(x.end_x for x in lines), max(x.size for x in lines), [s for x in lines for s in x.spans])


def cells_of(line: Line) -> list[list[Span]]:
    """Spans of a line, parted where the gap is over a space's width and a bit."""
    out: list[list[Span]] = []
    for s in line.spans:
        if not s.text.strip():
            continue
        if out and s.x - max(o.end_x for o in out[-1]) <= WORD_CELL * s.size:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def lane_tables(lines: list[Line]) -> list[Line | Block]:
    """Lines with stretches of at least three even rows that keep two or more lanes apart turned into tables."""
    out: list[Line | Block] = []
    cells = [cells_of(x) if len(x.spans) > 1 else [] for x in lines]
    ext = [[(c[0].x, c[0].end_x if len(c) == 1 else max([s.end_x for s in c])) for c in r] for r in cells]
    k = 0
    while k < len(lines):
        end, columns = even_rows(ext, k)
        table = lane_block(cells[k:end], ext[k:end], columns, lines[k:end]) if end - k >= 3 else None
        if table:
            out.append(table)
            k = end
        else:
            out.append(lines[k])
            k += 1
    return out


def even_rows(rows: list[list[tuple[float, float]]], first: int) -> tuple[int, list[tuple[float, float]]]:
    """The end of the even rows from the first on, and their columns: unions of overlapping cells of the rows that have most, parted by lanes of over 6 points. A row is even if the rows up to it have two columns or more and no row's cells share one.

    Columns grow row by row; while they stay as they were, only the new row is compared with them.
    """
    end, most, columns = first, 0, []
    while end < len(rows) and len(row := rows[end]) >= 2:
        found = columns
        if len(row) >= most:
            found = []
            for a, b in sorted([*columns, *row] if len(row) == most else row):
                if found and a <= found[-1][1] + GAP:
                    found[-1] = found[-1][0], max(found[-1][1], b)
                else:
                    found.append((a, b))
        if len(found) < 2 or not all(keeps_apart(r, found) for r in (rows[first : end + 1] if found != columns else [row])):
            break
        end, most, columns = end + 1, max(most, len(row)), found
    return end, columns


def keeps_apart(row: list[tuple[float, float]], columns: list[tuple[float, float]]) -> bool:
    """Do the cells of a row lie in columns of their own, from left to right?"""
    at = -1
    for x0, x1 in row:
        hit = [k for k, (a, b) in enumerate(columns) if x0 < b + 1 and x1 > a - 1]
        if hit and hit[0] <= at:
            return False
        at = hit[-1] if hit else at
    return True


def lane_block(rows, ext, columns: list[tuple[float, float]], lines: list[Line]) -> Block | None:
    steps = [a.y - b.y for a, b in zip(lines, lines[1:], strict=False)]
    if len(columns) < 3 or max(steps) > 2 * upper_median(steps):
        return None
    starts = [a for a, _ in columns]
    out = []
    for r, e in zip(rows, ext, strict=True):
        cells: list[tuple[Line | None, int]] = []
        at = 0
        for c, (x0, x1) in zip(r, e, strict=True):
            a = max(0, bisect_right(starts, x0 + 0.5) - 1)
            b = max(a, bisect_right(starts, x1 - 0.5) - 1)
            if a > at:
                cells += [(None, 1)] * (a - at)
            a = max(a, at)
            n = max(1, b - a + 1)
            cells.append((assemble(c), n))
            at = a + n
        cells += [(None, 1)] * (len(columns) - at)
        out.append(cells)
    if sum(any(col < len(r) and r[col][0] for r in out) for col in range(len(columns))) < 3:
        return None
    return Block("table", [], rows=out)


# blocks


def marker(text: str) -> tuple[int, str, int | None] | None:
    """(length, bullet, number) of a list marker."""
    m = _MARKER.match(text)
    return (m.end(), m[1] or "", int(m[2]) if m[2] else None) if m and m.end() < len(text) + 1 else None


def is_title(line: Line) -> bool:
    if len(line.inlines) == 1 and not line.inlines[0][1]:
        return False
    t = line.text.strip()
    return bool(t) and len(t) <= TITLE_CHARS and t[-1] not in ".,;" and all(b for x, b, _ in line.inlines if x.strip())


def blocks_of(lines: list[Line | Block], sizes: Sizes) -> list[Block]:
    out: list[Block] = []
    run: list[Line] = []

    def flush():
        out.extend(prose(run))
        run.clear()

    all_bold = all(is_title(x) or all(b for t, b, _ in x.inlines if t.strip()) for x in lines if isinstance(x, Line))
    for x in lines:
        if isinstance(x, Block):
            flush()
            out.append(x)
            continue
        level = sizes.level(x)
        if not level and not all_bold and is_title(x):
            level = min(6, len(sizes.ladder) + 1)
        if level:
            last = out[-1] if out and not run else None
            if last and last.kind == "heading" and last.level == level and half_points(last.lines[-1].size) == half_points(x.size) and 0 <= last.lines[-1].y - x.y <= PARAGRAPH * x.size:
                last.lines.append(x)
            else:
                flush()
                out.append(Block("heading", [x], level))
        else:
            run.append(x)
    flush()
    done: list[Block] = []
    for b in out:
        if b.kind == "heading" and len(" ".join(x.text.strip() for x in b.lines)) > HEAD_CHARS:
            done += prose(b.lines)
        else:
            done.append(b)
    return done


def prose(lines: list[Line]) -> list[Block]:
    """Lists, and paragraphs parted where a step is over 1.8 of the median step."""
    out: list[Block] = []
    steps = [a.y - b.y for a, b in zip(lines, lines[1:], strict=False) if a.y > b.y]
    limit = PARAGRAPH * upper_median(steps) if steps else math.inf
    k = 0
    while k < len(lines):
        items, end = [], k
        while end < len(lines):
            m = marker(lines[end].text)
            if m:
                items.append((m[1], m[2], m[0], [end - k]))
            elif not items or lines[end].x <= lines[k].x + 1 or lines[end - 1].y - lines[end].y > limit:
                break
            else:
                items[-1][3].append(end - k)
            end += 1
        if len(items) >= 2:
            out.append(Block("list", lines[k:end], items=items))
            k = end
            continue
        if out and out[-1].kind == "paragraph" and 0 < out[-1].lines[-1].y - lines[k].y <= limit:
            out[-1].lines.append(lines[k])
        else:
            out.append(Block("paragraph", [lines[k]]))
        k += 1
    return out


def page_blocks(spans: list[Span], rulings: list[Ruling] = (), sizes: Sizes | None = None) -> list[Block]:
    sizes = sizes or Sizes(spans)
    tables = []
    for xs, ys in grids(list(rulings)) if rulings else []:
        t, spans = ruled_table(spans, xs, ys)
        if t:
            tables.append((ys[0], t))
    if not tables:
        return [b for seg in segments(spans) for b in blocks_of(lane_tables(group_lines(seg)), sizes)]
    out: list[Block] = []
    top = math.inf
    for y, t in [*tables, (-math.inf, None)]:
        part = [s for s in spans if y <= s.y < top]
        out += [b for seg in segments(part) for b in blocks_of(lane_tables(group_lines(seg)), sizes)] if part else []
        out += [t] if t else []
        top = y
    return out


# running headers and footers


_DIGITS = re.compile(r"\d+")


def normalise(text: str) -> str:
    return " ".join(_DIGITS.sub("#", text).split()).lower()


_PAGE_NUMBER = re.compile(r"#|page #|(?:page )?# (?:of|/) #|[-–—] ?# ?[-–—]")


def is_page_number(text: str) -> bool:
    return bool(_PAGE_NUMBER.fullmatch(normalise(text)))


def tag_roles(pages: list[list[Block]]) -> None:
    """From three pages on, the last and the first line of each page is a footer or header if it is a page number or repeats on enough pages at the same height."""
    if len(pages) < 3:
        return
    for role, at in (("footer", -1), ("header", 0)):
        edge = [(k, line, normalise(line.text)) for k, p in enumerate(pages) if p and p[at].role is None and p[at].kind in ("paragraph", "heading") for line in (p[at].lines[at],)]
        seen: dict[str, Counter] = defaultdict(Counter)
        for _, line, norm in edge:
            seen[norm][line.y] += 1
        need = max(3, len(pages) // 2)
        near: dict = {}  # most edges of a text stand at one height
        for k, line, norm in edge:
            if (norm, line.y) not in near:
                near[norm, line.y] = sum([n for y, n in seen[norm].items() if abs(y - line.y) <= 2])
            if near[norm, line.y] >= need or _PAGE_NUMBER.fullmatch(norm):
                b = pages[k][at]
                if len(b.lines) == 1:
                    b.role = role
                else:
                    del b.lines[at]
                    pages[k].insert(len(pages[k]) if at else 0, Block("paragraph", [line], role=role))


# output


def text_of(spans: list[Span]) -> str:
    return "\n".join(x.text for seg in segments(spans) for x in group_lines(seg))


def escape(text: str) -> str:
    return text.replace("|", "\\|")


def hash_escape(text: str) -> str:
    return re.sub(r"^(\s*)#", r"\1\\#", text)


def html_escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def emphasis(line: Line, plain: bool = False, skip: int = 0, esc=escape) -> str:
    out = []
    for t, b, i in line.inlines:
        if skip:
            t, skip = t[skip:], max(0, skip - len(t))
        mark = "*" * (2 * b + i)
        if plain or not mark or not any(c.isalnum() for c in t):
            out.append(esc(t))
            continue
        core = t.strip()
        lead = t[: len(t) - len(t.lstrip())]
        out.append(lead + mark + esc(core) + mark + t[len(lead) + len(core) :])
    return "".join(out)


def markdown(pages: list[list[Block]]) -> str:
    return "\n\n".join(x for p in pages for b in p if b.role is None and (x := block_markdown(b)))


def block_markdown(b: Block) -> str:
    if b.kind == "heading":
        return "#" * b.level + " " + " ".join(emphasis(x, plain=True).strip() for x in b.lines)
    if b.kind == "list":
        out = []
        for _, number, length, at in b.items:
            first = emphasis(b.lines[at[0]], skip=length).strip()
            rest = [emphasis(b.lines[k]).strip() for k in at[1:]]
            out.append((f"{number}. " if number is not None else "- ") + " ".join([first, *rest]))
        return "\n".join(out)
    if b.kind == "table":
        return table_markdown(b)
    return "\n".join(hash_escape(emphasis(x)) for x in b.lines)


def table_markdown(b: Block) -> str:
    if any(n > 1 for r in b.rows for _, n in r):
        cell = lambda c, n, tag: f"<{tag}{f' colspan="{n}"' if n > 1 else ''}>{html_escape(c.text.strip()) if c else ''}</{tag}>"
        rows = ["<tr>" + "".join(cell(c, n, "td" if k else "th") for c, n in r) + "</tr>" for k, r in enumerate(b.rows)]
        return "<table>\n" + "\n".join(rows) + "\n</table>"
    rows = ["| " + " | ".join(escape(c.text.strip()) if c else "" for c, _ in r) + " |" for r in b.rows]
    return "\n".join([rows[0], "| " + " | ".join("---" for _ in b.rows[0]) + " |", *rows[1:]])


def _as_markdown(pages: list) -> str:
    sizes = Sizes(s for p in pages for s in p.spans)
    blocks = [page_blocks(p.spans, p.rulings, sizes) for p in pages]
    tag_roles(blocks)
    return markdown(blocks)


#: Outputs by name: what is read of all pages, to text.
OUTPUTS = {"text": lambda pages: "\f".join(text_of(p.spans) for p in pages), "markdown": _as_markdown}
