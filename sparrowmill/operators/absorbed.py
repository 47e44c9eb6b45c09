"""Texts that blank elements take from all below them, cut from their pages by pre-order intervals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from sparrowmill.functions import markup

_NODES = pa.list_(pa.struct([("pos", pa.int32()), ("end", pa.int32()), ("tag", pa.string()), ("names", pa.list_(pa.string())), ("direct", pa.list_(pa.string())), ("begin_text", pa.int32()), ("end_text", pa.int32())]))
_DOCUMENT = pa.struct([("nodes", _NODES), ("texts", pa.list_(pa.string()))])


def _read(text: str | None) -> dict:
    doc = markup.parsed(text)
    nodes = [{"pos": k, "end": n.end, "tag": n.tag.lower(), "names": sorted(n.named()), "direct": [x.strip() for x in n.direct], "begin_text": n.begin_text, "end_text": n.end_text} for k, n in enumerate(doc.nodes)]
    return {"nodes": nodes, "texts": doc.texts}


@F.arrow_udf(from_arrow_type(_DOCUMENT))
def document(texts: pa.Array) -> pa.Array:
    """Elements with their place, the place after their subtree, their own names and texts, and the stretch of the page's texts below them."""
    return pa.array([_read(x.as_py()) for x in texts], _DOCUMENT)


def full_texts(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, tag, text): each element's own names and direct texts; if it has none, the names of all below it and their joined texts.

    What lies below an element is a stretch of its page's elements and of its page's texts, which the parser gives in one row, so it is
    cut from there: nothing is joined or shuffled, and a page costs what its texts are long.
    """
    read = pages.select(F.col(key).alias("key"), document(text).alias("d"))
    nodes, texts = F.col("d.nodes"), F.col("d.texts")

    def below(e: Column) -> Column:
        named = F.filter(F.slice(nodes, e["pos"] + 2, e["end"] - e["pos"] - 1), lambda x: F.size(x["names"]) > 0)
        pieces = F.slice(texts, e["begin_text"] + 1, e["end_text"] - e["begin_text"])
        whole = F.when(F.size(pieces) > 0, F.array(F.array_join(pieces, " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.flatten(F.transform(named, lambda x: x["names"])), whole)

    def shown(e: Column) -> Column:
        own = F.concat(e["names"], e["direct"])
        found = F.when(F.size(own) > 0, own).otherwise(below(e))
        return F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), F.array_join(F.array_sort(F.array_distinct(found)), " | ").alias("text"))

    return read.select("key", F.inline(F.transform(nodes, shown)))
