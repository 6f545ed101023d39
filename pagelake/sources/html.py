"""Page HTML to element arrays: one row in, one row out, without a shuffle.

The tolerant HTML reading is the one step here that built-in functions cannot express, so it runs
in ``mapInArrow``. Everything it returns is plain columns: ``texts`` holds the stripped text runs
of the page in order, ``nodes`` the elements in document order, and ``places`` lists the nodes by tag, class, id
and attribute. A node's text is a slice of
``texts`` (``t0`` to ``t1``) and its ancestors are positions in ``nodes``: listed in ``anc`` down to
``LISTED_DEPTH``, and below it those whose descendants reach past the node. So a page of any depth
takes memory in proportion to its elements, and every later step is a Column expression over the same row.
"""

from __future__ import annotations

import html as html_entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.sources.places import PLACES_TYPE, page_index

NODE_TYPE = T.StructType(
    [
        T.StructField("i", T.IntegerType()),  # position in nodes, document order
        T.StructField("last", T.IntegerType()),  # position of the last descendant
        T.StructField("tag", T.StringType()),
        T.StructField("cls", T.StringType()),  # class names joined by one space, NULL if absent
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("noise", T.BooleanType()),  # inside script, style, noscript, iframe, svg
        T.StructField("t0", T.IntegerType()),
        T.StructField("t1", T.IntegerType()),
        T.StructField("anc", T.ArrayType(T.IntegerType())),  # ancestors, outermost first; NULL when too deep
    ]
)
TEXT_TYPE = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("owner", T.StringType()),  # script, style, template, rt, rp or ""
        T.StructField("noise", T.BooleanType()),
    ]
)

# HTML element sets.
VOID = frozenset(
    "area base basefont br col embed frame hr img input isindex link meta param source track wbr".split()
)
RAW_TEXT = frozenset(["script", "style"])
TEXT_OWNERS = frozenset(["script", "style", "template", "rt", "rp"])
NOISE = frozenset(["script", "style", "noscript", "iframe", "svg"])
HEAD_ONLY = frozenset(["title", "meta", "link", "base", "style", "script", "noscript", "template"])
INLINE = frozenset(
    "a abbr b big cite code em font i kbd label mark q s samp small span strike strong sub sup tt u var".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
BLOCKS = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer "
    "form header hgroup hr main menu nav ol p pre section table ul".split()
)
# Open elements that a start tag ends.
ENDED_BY_START = {
    **{tag: frozenset(["p"]) for tag in BLOCKS},
    **{tag: HEADINGS | {"p"} for tag in HEADINGS},
    "a": frozenset(["a"]),
    "li": frozenset(["li", "p"]) | HEADINGS,
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "tr": frozenset(["td", "th", "tr", "p"]),
    "tbody": frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "p"]),
    "thead": frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "p"]),
    "tfoot": frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "p"]),
}
# An end tag does not reach past an open element of higher rank.
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}
DEFAULT_RANK = 100
LISTED_DEPTH = 256  # deeper elements leave ``anc`` NULL; ``ancestors`` finds theirs from ``last``

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNQUOTED_TAIL = re.compile(r"=\s*[^\s\"'>]*/$")  # the slash belongs to a value
_RAW_END = {tag: re.compile(rf"</{tag}\s*/?>", re.IGNORECASE) for tag in RAW_TEXT}


class _Columns:
    """Flat columns of the nodes and texts of several pages."""

    def __init__(self) -> None:
        self.text_offsets, self.node_offsets = [0], [0]
        self.s, self.owner, self.text_noise = [], [], []
        self.last, self.i, self.tag, self.cls, self.noise = [], [], [], [], []
        self.t0, self.t1 = [], []
        self.attr_offsets, self.keys, self.values = [0], [], []
        self.anc_offsets, self.anc = [0], []

    def add_page(self, source: str | None) -> None:
        _Reader(self).read(source or "")
        self.text_offsets.append(len(self.s))
        self.node_offsets.append(len(self.tag))

    def arrays(self) -> list[pa.Array]:
        texts = pa.StructArray.from_arrays(
            [pa.array(self.s, pa.string()), pa.array(self.owner, pa.string()), pa.array(self.text_noise, pa.bool_())],
            names=["s", "owner", "noise"],
        )
        keys, values = pa.array(self.keys, pa.string()), pa.array(self.values, pa.string())
        attrs = pa.MapArray.from_arrays(pa.array(self.attr_offsets, pa.int32()), keys, values)
        tags, classes = pa.array(self.tag, pa.string()), pa.array(self.cls, pa.string())
        anc = pa.ListArray.from_arrays(pa.array(self.anc_offsets, pa.int32()), pa.array(self.anc, pa.int32()))
        nodes = pa.StructArray.from_arrays(
            [
                pa.array(self.i, pa.int32()),
                pa.array(self.last, pa.int32()),
                tags,
                classes,
                attrs,
                pa.array(self.noise, pa.bool_()),
                pa.array(self.t0, pa.int32()),
                pa.array(self.t1, pa.int32()),
                anc,
            ],
            names=NODE_TYPE.names,
        )
        return [
            pa.ListArray.from_arrays(pa.array(self.text_offsets, pa.int32()), texts),
            pa.ListArray.from_arrays(pa.array(self.node_offsets, pa.int32()), nodes),
            page_index(np.array(self.node_offsets), tags, classes, np.array(self.attr_offsets), keys, values),
        ]


class _Tags:
    """Reads the tag or comment at a ``<``. All reads of a page together take time in proportion to its length.

    A read that succeeds is not repeated, and one that fails is cut short by what earlier reads have learned: where the
    next ``>`` is, where the last quote of each kind is, and from which places no tag can be completed.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        self.next_close = -1
        self.last_quote = {quote: source.rfind(quote) for quote in "\"'"}
        self.hopeless: set[int] = set()

    def close(self, at: int) -> int:
        """Position of the first ``>`` from ``at`` on, or the page's length."""
        if self.next_close < at:
            found = self.source.find(">", at)
            self.next_close = found if found >= 0 else len(self.source)
        return self.next_close

    def read(self, at: int) -> tuple[str, str, str, int] | None:
        """(kind, name, attributes, position after it); None where the ``<`` is text."""
        source, lead = self.source, self.source[at + 1 : at + 2]
        if lead == "!" and source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            return "comment", "", "", end + 3 if end >= 0 else len(source)
        close = self.close(at + 1)
        if close == len(source):
            return None
        if lead in ("!", "?"):
            return "comment", "", "", close + 1
        name = _NAME.match(source, at + 2 if lead == "/" else at + 1)
        if name is None:
            return None
        if lead == "/":
            return "end", name[0].lower(), "", close + 1
        end = self.tag_end(name.end())
        end = close if end < 0 else end
        return "start", name[0].lower(), source[name.end() : end], end + 1

    def tag_end(self, at: int) -> int:
        """Position of the first ``>`` outside quotes, or -1 where a quote before it is never closed."""
        source, passed = self.source, []
        while at not in self.hopeless:
            mark = _MARK.search(source, at)
            if mark is None:
                break
            if mark[0] == ">":
                return mark.start()
            if self.last_quote[mark[0]] <= mark.start():
                break
            at = source.find(mark[0], mark.end()) + 1
            passed.append(at)
        self.hopeless.update(passed)
        return -1


class _Reader:
    """Open-element stack for one page."""

    def __init__(self, out: _Columns) -> None:
        self.out = out
        self.node_base, self.text_base = len(out.tag), len(out.s)
        self.names: list[str] = []
        self.ids: list[int] = []
        # Where in the stack each tag is open, where tags with a rank of their own are, and all that are not inline.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.ranked: dict[int, list[int]] = {rank: [] for rank in END_RANK.values()}
        self.barriers: list[int] = []
        self.noise_depth = 0
        self.owners: list[str] = []
        self.seen_head = self.seen_body = False
        self.pending: list[str] = []

    def read(self, source: str) -> None:
        tags, size = _Tags(source), len(source)
        position, at = 0, source.find("<")
        while at >= 0:
            token = tags.read(at)
            if token is None:
                at = source.find("<", at + 1)
                continue
            if at > position:
                self.pending.append(source[position:at])
            kind, name, attrs, position = token
            if kind == "start":
                self.start(name, attrs)
                if name in RAW_TEXT and self.names and self.names[-1] == name:
                    end = _RAW_END[name].search(source, position)
                    stop = end.start() if end else size
                    self.pending.append(source[position:stop])
                    self.flush(raw=True)
                    self.close_to(len(self.names) - 1)
                    position = end.end() if end else size
            elif kind == "end":
                self.end(name)
            else:
                self.flush()
            at = source.find("<", position)
        if position < size:
            self.pending.append(source[position:])
        self.flush()
        self.close_to(0)

    def flush(self, raw: bool = False) -> None:
        if not self.pending:
            return
        joined = "".join(self.pending)
        self.pending.clear()
        text = (joined if raw else html_entities.unescape(joined)).strip()
        if not text:
            return
        if not self.names or self.names[-1] in ("html", "head"):
            self.imply("p")
            self.push("p", {})
        self.out.s.append(text)
        self.out.owner.append(self.owners[-1] if self.owners else "")
        self.out.text_noise.append(self.noise_depth > 0)

    def imply(self, tag: str) -> None:
        """Open html, head or body when ``tag`` needs one that was left out."""
        if not self.names:
            self.push("html", {})
        if tag in ("head", "body", "frameset") or self.seen_body:
            return
        if tag in HEAD_ONLY:
            if not self.seen_head:
                self.seen_head = True
                self.push("head", {})
        elif self.names[-1] in ("html", "head"):
            self.close_to(1)
            self.seen_body = True
            self.push("body", {})

    def start(self, tag: str, raw_attrs: str) -> None:
        if tag == "html" and self.names:
            return
        if (tag == "head" and self.seen_head) or (tag == "body" and self.seen_body):
            return
        self.flush()
        if tag != "html":
            self.imply(tag)
        if tag == "head":
            self.seen_head = True
        elif tag == "body":
            self.close_to(1)
            self.seen_body = True
        ends = ENDED_BY_START.get(tag)
        if ends:
            self.close_implied(ends)
        attrs: dict[str, str] = {}
        for key, value in _ATTR.findall(raw_attrs):
            if value[:1] in ("'", '"') and len(value) > 1:
                value = value[1:-1]
            attrs.setdefault(key.lower(), html_entities.unescape(value) if "&" in value else value)
        self.push(tag, attrs)
        closed = raw_attrs.endswith("/") and not _UNQUOTED_TAIL.search(raw_attrs)
        if tag in VOID or (closed and tag not in ("html", "head", "body")):
            self.close_to(len(self.names) - 1)

    def close_implied(self, ends: frozenset[str]) -> None:
        """Close from the outermost element of ``ends`` on that only such and inline elements follow."""
        barrier = next((k for k in reversed(self.barriers) if self.names[k] not in ends), 0)
        found = [places[bisect_right(places, barrier)] for tag in ends if (places := self.open[tag]) and places[-1] > barrier]
        if found:
            self.close_to(min(found))

    def end(self, tag: str) -> None:
        places = self.open[tag]
        if not places or tag in ("html", "body") or tag in VOID:
            return
        rank = END_RANK.get(tag, DEFAULT_RANK)
        if not any(of > rank and above and above[-1] > places[-1] for of, above in self.ranked.items()):
            self.flush()
            self.close_to(places[-1])

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        out = self.out
        node = len(out.tag) - self.node_base
        if tag in NOISE:
            self.noise_depth += 1
        out.i.append(node)
        out.last.append(node)
        out.tag.append(tag)
        classes = attrs.get("class")
        out.cls.append(None if classes is None else " ".join(classes.split()))
        out.noise.append(self.noise_depth > 0)
        out.t0.append(len(out.s) - self.text_base)
        out.t1.append(0)
        out.keys.extend(attrs.keys())
        out.values.extend(attrs.values())
        out.attr_offsets.append(len(out.keys))
        if len(self.ids) <= LISTED_DEPTH:
            out.anc.extend(self.ids)
        else:
            out.anc_offsets[-1] = None
        out.anc_offsets.append(len(out.anc))
        depth = len(self.names)
        self.open[tag].append(depth)
        if tag in END_RANK:
            self.ranked[END_RANK[tag]].append(depth)
        if tag not in INLINE:
            self.barriers.append(depth)
        self.names.append(tag)
        self.ids.append(node)
        if tag in TEXT_OWNERS:
            self.owners.append(tag)

    def close_to(self, depth: int) -> None:
        """Close open elements until ``depth`` of them are left."""
        out = self.out
        while len(self.names) > depth:
            tag, node = self.names.pop(), self.ids.pop() + self.node_base
            self.open[tag].pop()
            if tag in END_RANK:
                self.ranked[END_RANK[tag]].pop()
            if tag not in INLINE:
                self.barriers.pop()
            out.t1[node] = len(out.s) - self.text_base
            out.last[node] = len(out.tag) - self.node_base - 1
            if tag in NOISE:
                self.noise_depth -= 1
            if tag in TEXT_OWNERS:
                self.owners.pop()


def ancestors(nodes: Column, node: Column) -> Column:
    """Positions of a node's ancestors, outermost first."""
    above = F.filter(F.slice(nodes, F.lit(1), node.i), lambda other: other["last"] >= node.i)
    return F.coalesce(node.anc, F.transform(above, lambda other: other.i))


#: Columns that parsing adds.
PARSED = ["texts", "nodes", "places"]
# Nodes per output batch, so that a worker holds one batch of its input and little besides; a single larger page still becomes one batch.
_NODES_PER_BATCH = 10_000


def parse_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace the HTML column by ``texts``, ``nodes`` and ``places`` (the index of the nodes); every other column passes through."""
    kept = [field for field in pages.schema.fields if field.name != html_col]
    names = [field.name for field in kept]
    schema = T.StructType(
        kept + [
            T.StructField("texts", T.ArrayType(TEXT_TYPE)), T.StructField("nodes", T.ArrayType(NODE_TYPE)),
            T.StructField("places", PLACES_TYPE),
        ]
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html_col))
            start, out = 0, _Columns()
            for row in range(batch.num_rows):
                out.add_page(column[row].as_py())
                if len(out.tag) >= _NODES_PER_BATCH or row == batch.num_rows - 1:
                    part = batch.slice(start, row + 1 - start)
                    passed = [part.column(part.schema.get_field_index(name)) for name in names]
                    yield pa.RecordBatch.from_arrays(passed + out.arrays(), names=names + PARSED)
                    start, out = row + 1, _Columns()

    return pages.mapInArrow(parse, schema)
