"""CSS selectors as data: selector text becomes a Column of alternatives, steps and tests.

Supported: tag, ``*``, ``.class``, ``#id``, attribute tests, ``:-soup-contains()``, compounds, the
descendant and child combinators and comma lists. Other selectors parse to NULL and match nothing;
``selector_problem`` names them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import as_col, let
from pagelake.sources.html import TEXT_OWNERS, ancestors

_TEST_TYPE = "struct<kind:string,key:string,op:string,value:string>"
PARSED_SELECTOR = f"array<struct<steps:array<struct<child:boolean,tests:array<{_TEST_TYPE}>>>,place:string>>"

_IDENT = r"[\w\-\x{80}-\x{10FFFF}]+"
_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\]\s\"']+)"
_ATTR = rf"\[\s*[\w:.\-]+\s*(?:[~|^$*!]?=\s*{_VALUE}\s*)?\]"
_CONTAINS = r":-soup-contains\(\s*(?:\"[^\"]*\"|'[^']*'|[^)\"',]*)\s*\)"
_QUALIFIER = rf"(?:[.#]{_IDENT}|{_ATTR}|{_CONTAINS})"
_COMPOUND = rf"(?:(?:\*|{_IDENT}){_QUALIFIER}*|{_QUALIFIER}+)"
_CHAIN = rf"{_COMPOUND}(?:(?:\s*>\s*|\s+){_COMPOUND})*"
_SELECTOR = rf"^\s*{_CHAIN}(?:\s*,\s*{_CHAIN})*\s*$"
_STEP = rf"(?:\s*>\s*|\s*){_COMPOUND}"
_TEST = rf"{_ATTR}|{_CONTAINS}|\*|[.#]?{_IDENT}"


def sanitize_selector(selector: Column | str) -> Column:
    """Old-style ``:contains(`` renamed; NULL becomes an empty selector."""
    renamed = F.regexp_replace(as_col(selector), r":contains(?=\s*\()", ":-soup-contains")
    return F.coalesce(renamed, F.lit(""))


def _unquote(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), r"^([\"'])(.*)\1$", "$2")


def _parse_test(raw: Column) -> Column:
    first = F.substring(raw, 1, 1)
    attr_name = F.lower(F.regexp_extract(raw, r"^\[\s*([\w:.\-]+)", 1))
    attr_op = F.regexp_extract(raw, r"^\[\s*[\w:.\-]+\s*([~|^$*!]?=)", 1)
    attr_value = _unquote(F.regexp_extract(raw, r"(?s)^\[\s*[\w:.\-]+\s*[~|^$*!]?=(.*)\]$", 1))
    contained = _unquote(F.regexp_extract(raw, r"(?s)^:-soup-contains\((.*)\)$", 1))
    kind = (
        F.when(first == "[", "attr")
        .when(first == ":", "contains")
        .when(first == ".", "class")
        .when(first == "#", "attr")
        .when(first == "*", "any")
        .otherwise("tag")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(first == "[", attr_name).when(first == "#", "id").otherwise("").alias("key"),
        F.when(first == "[", attr_op).when(first == "#", "=").otherwise("").alias("op"),
        F.when(first == "[", attr_value)
        .when(first == ":", contained)
        .when(first.isin(".", "#"), F.substr(raw, F.lit(2)))
        .otherwise(F.lower(raw))
        .alias("value"),
    )


def _place(tests: Column) -> Column:
    """Key of a page's index that lists every node passing ``tests``, the rarest kind first; NULL where there is none."""

    def named(mark: str, wanted: Callable[[Column], Column], part: str) -> Column:
        return F.concat(F.lit(mark), F.get(F.filter(tests, wanted), 0)[part])

    return F.coalesce(
        named("#", lambda t: (t.kind == "attr") & (t.key == "id") & (t.op == "="), "value"),
        named(".", lambda t: t.kind == "class", "value"),
        named("[", lambda t: (t.kind == "attr") & (t.op != "!="), "key"),
        named("", lambda t: t.kind == "tag", "value"),
    )


def parse_selector(selector: Column | str) -> Column:
    """``PARSED_SELECTOR``: one entry per comma alternative, with its steps and the key of the index it starts from."""
    text = sanitize_selector(selector)

    def parse_step(raw: Column) -> Column:
        return F.struct(
            raw.rlike(r"^\s*>").alias("child"),
            F.transform(
                F.regexp_extract_all(raw, F.lit(f"({_TEST})"), F.lit(1)), _parse_test
            ).alias("tests"),
        )

    def parse_chain(raw: Column) -> Column:
        steps = F.regexp_extract_all(raw, F.lit(f"({_STEP})"), F.lit(1))
        return let(F.transform(steps, parse_step), lambda parsed: F.struct(parsed.alias("steps"), _place(F.element_at(parsed, -1).tests).alias("place")))

    chains = F.regexp_extract_all(text, F.lit(f"({_CHAIN})"), F.lit(1))
    return F.when(text.rlike(_SELECTOR), F.transform(chains, parse_chain))


def selector_problem(selector: Column | str) -> Column:
    """The selector text when it is not empty and not supported, else NULL."""
    text = sanitize_selector(selector)
    return F.when((text != "") & ~text.rlike(_SELECTOR), text)


def node_text(texts: Column, node: Column, clean: bool = False) -> Column:
    """Stripped text runs of a node, joined without a separator."""
    own = F.when(node.tag.isin(sorted(TEXT_OWNERS)), node.tag).otherwise("")
    runs = F.slice(texts, node.t0 + 1, node.t1 - node.t0)
    wanted = F.filter(runs, lambda run: (run.owner == own) & (~run.noise if clean else F.lit(True)))
    return F.array_join(F.transform(wanted, lambda run: run.s), "")


def attr(node: Column, name: Column | str) -> Column:
    return F.try_element_at(node.attrs, F.lit(name) if isinstance(name, str) else name)


def _test_attr(actual: Column, test: Column) -> Column:
    spaced = F.concat(F.lit(" "), actual, F.lit(" "))
    some = test.value != ""
    return (
        F.when(test.op == "!=", ~F.coalesce(actual == test.value, F.lit(False)))
        .when(actual.isNull(), False)
        .when(test.op == "", True)
        .when(test.op == "=", actual == test.value)
        .when(test.op == "~=", some & spaced.contains(F.concat(F.lit(" "), test.value, F.lit(" "))))
        .when(test.op == "^=", some & actual.startswith(test.value))
        .when(test.op == "$=", some & actual.endswith(test.value))
        .when(test.op == "*=", some & actual.contains(test.value))
        .when(
            test.op == "|=",
            (actual == test.value) | actual.startswith(F.concat(test.value, F.lit("-"))),
        )
        .otherwise(False)
    )


def _passes(node: Column, tests: Column, texts: Column) -> Column:
    def one(test: Column) -> Column:
        padded = F.concat(F.lit(" "), node.cls, F.lit(" "))
        actual = F.when(test.key == "class", node.cls).otherwise(attr(node, test.key))
        return F.coalesce(
            F.when(test.kind == "tag", node.tag == test.value)
            .when(test.kind == "class", padded.contains(F.concat(F.lit(" "), test.value, F.lit(" "))))
            .when(test.kind == "attr", _test_attr(actual, test))
            .when(test.kind == "contains", node_text(texts, node).contains(test.value))
            .otherwise(True),
            F.lit(False),
        )

    return F.forall(tests, one)


def _ancestors_pass(nodes: Column, texts: Column, node: Column, steps: Column) -> Column:
    """Whether the steps before the last one match along the ancestors, outermost first.

    The fold carries, per step, whether the chain up to it ends exactly at the ancestor just seen
    (``here``) and whether it ends at any ancestor so far (``above``); that decides both
    combinators exactly, without trying alternatives.
    """
    before = F.size(steps) - 1
    nothing = F.array_repeat(F.lit(False), before)
    start = F.struct(nothing.alias("here"), nothing.alias("above"))

    def advance(state: Column, position: Column) -> Column:
        def at(ancestor: Column) -> Column:
            return F.transform(
                F.slice(steps, 1, before),
                lambda step, j: F.when(
                    (j == 0)
                    | F.when(step.child, F.get(state.here, j - 1)).otherwise(F.get(state.above, j - 1)),
                    _passes(ancestor, step.tests, texts),
                ).otherwise(False),
            )

        def combine(here: Column) -> Column:
            return F.struct(
                here.alias("here"),
                F.zip_with(here, state.above, lambda a, b: a | b).alias("above"),
            )

        return let(let(F.get(nodes, position), at), combine)

    end = F.aggregate(ancestors(nodes, node), start, advance)
    last_is_child = F.element_at(steps, -1).child
    return let(
        end,
        lambda state: F.when(last_is_child, F.get(state.here, before - 1)).otherwise(
            F.get(state.above, before - 1)
        ),
    )


def node_matches(nodes: Column, texts: Column, node: Column, chain: Column) -> Column:
    last = F.element_at(chain.steps, -1)
    return F.when(
        _passes(node, last.tests, texts),
        F.when(F.size(chain.steps) == 1, True).otherwise(_ancestors_pass(nodes, texts, node, chain.steps)),
    ).otherwise(False)


def select_nodes(nodes: Column, texts: Column, places: Column, parsed: Column) -> Column:
    """Nodes matching the parsed selector, in document order; empty for an unsupported one.

    Only the nodes that the index lists for the selector's last step are looked at. A step without anything the index
    knows (``*``, ``:-soup-contains()``, ``!=``) looks at all.
    """

    def hits(chain: Column) -> Column:
        listed = F.when(chain.place.isNull(), F.transform(nodes, lambda n: n.i)).otherwise(F.try_element_at(places, chain.place))
        return F.filter(
            F.coalesce(listed, F.array().cast("array<int>")),
            lambda i: let(F.get(nodes, i), lambda node: node_matches(nodes, texts, node, chain)),
        )

    def in_order(found: Column) -> Column:
        return F.when(F.size(found) == 1, F.get(found, 0)).otherwise(F.array_sort(F.array_distinct(F.flatten(found))))

    positions = let(F.transform(parsed, hits), in_order)
    return F.coalesce(F.transform(positions, lambda i: F.get(nodes, i)), F.slice(nodes, 1, 0))


@lru_cache(maxsize=4096)
def _parsed_json(selectors: tuple[str, ...]) -> tuple[str, ...]:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(list(enumerate(selectors)), "n int, s string").select("n", F.to_json(parse_selector("s")).alias("j"))
    found = {r.n: r.j for r in rows.collect()}
    return tuple(found[n] or "[]" for n in range(len(selectors)))


def literal_selectors(selectors: list[str]) -> list[Column]:
    """Selectors known beforehand, parsed once for all rows and runs of a session; unsupported ones match nothing."""
    return [F.from_json(F.lit(j), PARSED_SELECTOR) for j in _parsed_json(tuple(selectors))]
