"""Where on a page its tags, classes, ids and attributes stand: the index that selectors start from.

A page's index maps ``div`` (a tag), ``.item`` (a class), ``#main`` (an id) and ``[href`` (an attribute) to the positions
of the nodes that have it, in document order. It is built for a whole batch of pages at once, from columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

PLACES_TYPE = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))


def page_index(
    node_offsets: np.ndarray, tags: pa.Array, classes: pa.Array, attr_offsets: np.ndarray, keys: pa.Array, values: pa.Array
) -> pa.MapArray:
    """One map a page; ``node_offsets`` bounds the pages' nodes and ``attr_offsets`` the nodes' attributes."""
    of_node = np.arange(len(tags))
    listed = pc.split_pattern(classes, " ")
    class_names, of_class = pc.list_flatten(listed), np.asarray(pc.list_parent_indices(listed))
    some = np.asarray(pc.not_equal(class_names, ""))
    of_attr = np.repeat(of_node, np.diff(attr_offsets))
    is_id = pc.equal(keys, "id")
    marked = lambda mark, names: pc.binary_join_element_wise(mark, names, "")
    names = pa.concat_arrays([
        tags, marked(".", class_names.filter(pa.array(some))), marked("[", keys), marked("#", values.filter(is_id)),
    ]).dictionary_encode()
    node = np.concatenate([of_node, of_class[some], of_attr, of_attr[np.asarray(is_id)]])
    name = np.asarray(names.indices)
    page = np.searchsorted(node_offsets, node, side="right") - 1
    order = np.lexsort((node, name, page))
    node, name, page = node[order], name[order], page[order]
    # A node may have a class twice.
    fresh = np.ones(len(node), bool)
    fresh[1:] = (node[1:] != node[:-1]) | (name[1:] != name[:-1])
    node, name, page = node[fresh], name[fresh], page[fresh]
    first = np.ones(len(node), bool)
    first[1:] = (name[1:] != name[:-1]) | (page[1:] != page[:-1])
    at = np.flatnonzero(first)
    positions = pa.ListArray.from_arrays(pa.array(np.append(at, len(node)), pa.int32()), pa.array(node - node_offsets[page], pa.int32()))
    bounds = np.searchsorted(page[at], np.arange(len(node_offsets)))
    return pa.MapArray.from_arrays(pa.array(bounds, pa.int32()), names.dictionary.take(pa.array(name[at])), positions)
