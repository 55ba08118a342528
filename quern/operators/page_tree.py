"""The tree of a page: its elements in order, each with its parent, its text and its container.

One pass over the HTML of a page, in Arrow batches inside the scan's own tasks, so nothing is
shuffled. What queries ask of the tree afterwards is an expression over arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without content, and elements whose content is text up to their end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: What a starting element closes, and inside of what it looks for it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
#: Elements that close an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Names and classes of containers of a link, and of what describes one.
CONTAINERS, CONTAINER_CLASSES = frozenset(("article", "li", "div")), frozenset(("post", "entry", "card", "item"))
ABOUT, ABOUT_CLASSES = frozenset(("p",)), frozenset(("excerpt", "description", "summary"))

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

ELEMENT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("box", T.IntegerType()),
    T.StructField("image", T.IntegerType()), T.StructField("about", T.IntegerType()),
])


class _Tree:
    """Elements as lists of the fields of ELEMENT, and the pieces of text between tags."""

    def __init__(self, html: str):
        self.elements: list[list] = []
        self.pieces: list[str] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}
        at = 0
        while at < len(html):
            tag = _TAG.search(html, at)
            self._text(html[at : tag.start() if tag else len(html)])
            if tag is None:
                break
            at = tag.end()
            if tag[2] is None:  # a comment
                continue
            name = tag[2].lower()
            if tag[1]:
                self._close(name)
                continue
            self._start(name, tag[3])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                self._text(html[at:stop], plain=name in ("textarea", "title"))
                at = stop
            elif name in VOID:
                self._end(self.open.pop())
        while self.open:
            self._end(self.open.pop())

    def _text(self, text: str, plain: bool = True) -> None:
        if text:
            self.pieces.append(unescape(text) if plain else text)

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and self.count.get("p"):
            self._pop_to(("p",), ())
        if name in ENDS:
            ends, inside = ENDS[name]
            while self._pop_to(ends, inside):
                pass
        attrs: dict[str, str] = {}
        for key, *values in _ATTRIBUTE.findall(attributes):
            attrs.setdefault(key.lower(), unescape(next((v for v in values if v), "")))
        parent, i = self.open[-1] if self.open else -1, len(self.elements)
        classes = set(attrs.get("class", "").split())
        box = i if name in CONTAINERS or classes & CONTAINER_CLASSES else self.elements[parent][6] if parent >= 0 else -1
        self.elements.append([name, list(attrs.items()), parent, i, len(self.pieces), len(self.pieces), box, -1, -1])
        self.open.append(i)
        self.count[name] = self.count.get(name, 0) + 1
        # The first of a kind inside every element that has none yet; those above have one then.
        for field, fits in ((7, name == "img"), (8, name in ABOUT or classes & ABOUT_CLASSES)):
            up = parent if fits else -1
            while up >= 0 and self.elements[up][field] < 0:
                self.elements[up][field] = i
                up = self.elements[up][2]

    def _end(self, i: int) -> None:
        element = self.elements[i]
        element[3], element[5] = len(self.elements) - 1, len(self.pieces)
        self.count[element[0]] -= 1

    def _pop_to(self, names: tuple[str, ...], inside: tuple[str, ...]) -> bool:
        """End the nearest open element of those names and all in it; False where there is none."""
        if not any(self.count.get(n) for n in names):
            return False
        for k in range(len(self.open) - 1, -1, -1):
            name = self.elements[self.open[k]][0]
            if name in names:
                while len(self.open) > k:
                    self._end(self.open.pop())
                return True
            if name in inside:
                return False
        return False

    def _close(self, name: str) -> None:
        self._pop_to((name,), ())


def _parse(schema: pa.Schema, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                trees = [_Tree(h or "") for h in part.column(at).to_pylist()]
                elements = [[dict(zip(ELEMENT.names, e)) for e in t.elements] for t in trees]
                kept = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(elements, schema.field("elements").type), pa.array([t.pieces for t in trees], schema.field("pieces").type)], schema=schema)

    return run


def page_trees(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col`` and with ``elements`` and ``pieces``.

    An element has its name and attributes, lowered names; ``parent``, an index, -1 at the top;
    ``last``, the index of the last element in it; ``from`` and ``to``, its text as a range of
    ``pieces``; ``box``, the nearest container, itself included; ``image`` and ``about``, the
    first image and the first describing element in it; -1 where there is none.

    Ends that are left out are put where the start of a neighbour or the end of what is around
    them implies them; an end without a start is passed over; what is never ended reaches to
    the end of the page. Comments are left out; scripts, styles and noscript are text. Null
    and empty HTML have no elements. A page is one row of one task, in linear time unless
    quotes are left open.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in pages.columns if c not in ("elements", "pieces")]
    kept = [f for f in pages.select(*names).schema.fields if f.name != html_col]
    schema = T.StructType([*kept, T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("pieces", T.ArrayType(T.StringType()))])
    return pages.select(*names).mapInArrow(_parse(to_arrow_schema(schema), names.index(html_col)), schema)


def element_text(pieces: Column, element: Column) -> Column:
    """The text of an element and all in it, trimmed of white space."""
    inner = F.array_join(F.slice(pieces, element["from"] + 1, element["to"] - element["from"]), "")
    return F.regexp_replace(inner, r"^\s+|\s+$", "")


def attr(element: Column, *names: str) -> Column:
    """The first of the attributes that is there and not empty."""
    return F.coalesce(*(F.nullif(F.try_element_at(element["attrs"], F.lit(n)), F.lit("")) for n in names), F.lit(None).cast("string"))
