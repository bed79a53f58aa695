"""Headroom in XMP packets, as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace, its version, and what closes a packet's descriptions.
NAMESPACE, VERSION = "http://ns.apple.com/HDRGainMap/1.0/", 131072
PROPERTY = "HDRGainMapHeadroom"
CLOSE = "</rdf:RDF>"
_HEAD = '<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
_TAIL = CLOSE + '</x:xmpmeta><?xpacket end="w"?>'


def description(stops: Column) -> Column:
    linear = F.format_string("%.6f", F.pow(F.lit(2.0), stops))
    return F.concat(F.lit(f'<rdf:Description rdf:about="" xmlns:HDRGainMap="{NAMESPACE}" HDRGainMap:HDRGainMapVersion="{VERSION}" HDRGainMap:{PROPERTY}="'), linear, F.lit('"/>'))


def packet(stops: Column) -> Column:
    return F.concat(F.lit(_HEAD), description(stops), F.lit(_TAIL))


def merge(source: Column, stops: Column) -> Column:
    """The headroom put before the last close of the source's own packet; NULL without one."""
    at = F.length(source) - F.length(F.substring_index(source, CLOSE, -1)) - len(CLOSE)
    return F.when(F.contains(source, F.lit(CLOSE)), F.concat(F.substring(source, F.lit(1), at), description(stops), F.substring(source, at + 1, F.length(source))))


def value_of(text: Column, name: str) -> Column:
    """First numeric value of a property, as an attribute or an element."""
    hits = F.regexp_extract_all(text, F.lit(rf"""{name}\s*(?:=\s*["']([^"']*)["']|>([^<]*)<)"""), F.lit(0))
    numbers = F.transform(hits, lambda h: F.regexp_extract(h, r"""(?:=\s*["']|>)\s*([^"'<]*?)\s*["'<]""", 1).try_cast("double"))
    return F.get(F.array_compact(numbers), F.lit(0))
