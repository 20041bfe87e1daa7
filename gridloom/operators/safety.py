"""Guards on sources and documents: URLs, formats, ZIP budgets, HTML."""

from __future__ import annotations

import struct
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Known formats; entries, and bytes of one and of all entries, buffered or streaming.
FORMATS = ("pdf", "docx", "pptx", "xlsx", "xls", "doc", "ppt")
MAX_ENTRIES, BUFFERED, STREAMING = 4096, (32 << 20, 128 << 20), (512 << 20, 1024 << 20)


def document_format(source: Column, explicit: Column | None = None) -> Column:
    """The explicit format if given and known, else the extension of the decoded path, else null."""
    absolute = F.when(source.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), source).otherwise(F.concat(F.lit("https://document.invalid/"), F.ltrim(source, F.lit("/"))))
    path = F.coalesce(F.try_url_decode(F.regexp_replace(F.try_parse_url(absolute, F.lit("PATH")), r"\+", "%2B")), F.lit(""))
    found = F.lower(F.element_at(F.split(path, r"\."), -1))
    found = F.when(found.isin(*FORMATS), found)
    if explicit is None:
        return found
    return F.when(F.coalesce(explicit, F.lit("")) == "", found).otherwise(F.when(F.lower(explicit).isin(*FORMATS), F.lower(explicit)))


def safe_url(source: Column, origin: str = "https://document.invalid") -> Column:
    """True for safe relative paths and HTTPS addresses (HTTP only within the origin)."""
    text = F.coalesce(source, F.lit(""))
    bad = (text == "") | text.rlike(r"[\x00-\x20\\]") | text.startswith("//")
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#]*)", 1)
    secure = (scheme == "https") & (authority != "") & ~authority.contains("@")
    same = (scheme == "http") & (F.lower(F.concat(F.lit("http://"), authority)) == origin.lower()) & ~authority.contains("@")
    return ~bad & ((scheme == "") | secure | same)


class _Inert(HTMLParser):
    """Copies markup without active elements and attributes."""

    # Elements and attributes that are dropped, attributes whose addresses are checked.
    DROPPED = frozenset(("script", "iframe", "object", "embed", "meta", "link", "base"))
    VOID = frozenset(("embed", "meta", "link", "base"))
    ADDRESSES = frozenset(("href", "src", "action", "formaction", "xlink:href"))

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            if tag not in self.VOID:
                self.inside.append(tag)
            return
        if self.inside:
            return
        kept = []
        for name, value in attrs:
            scheme = (value or "").lstrip().lower()
            if name.startswith("on") or name == "srcdoc" or name in self.ADDRESSES and scheme.startswith(("javascript:", "vbscript:")):
                continue
            if not (tag == "img" and name == "loading"):
                kept.append(name if value is None else f'{name}="{escape(value)}"')
        if tag == "img":
            kept.append('loading="lazy"')
        self.out.append(f"<{' '.join([tag, *kept])}>")

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            if tag in self.inside:
                del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
        elif not self.inside:
            self.out.append(f"</{tag}>")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in self.inside[-1:]:
            self.inside.pop()

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def inert_html(html: str) -> str:
    parser = _Inert()
    parser.feed(html)
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(T.StringType())
def inert(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else inert_html(x))


def zip_directory(data: bytes, streaming: bool = False) -> list[tuple[str, int]]:
    """(name, declared size) of the entries of an archive within its budget; ValueError otherwise."""
    one, every = STREAMING if streaming else BUFFERED
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557), at + 3)
    if at < 0:
        raise ValueError("not an Office archive")
    disk, start_disk, _, count, _, offset, _ = struct.unpack_from("<4H2IH", data, at + 4)
    if disk or start_disk or count > MAX_ENTRIES:
        raise ValueError("the archive exceeds its limits")
    out, total = [], 0
    for _ in range(count):
        if offset + 46 > at or data[offset : offset + 4] != b"PK\x01\x02":
            raise ValueError("the archive's directory is damaged")
        flags, size, name, extra, comment = struct.unpack_from("<8xH14xI3H", data, offset)
        total += size
        if flags & 1 or size > one or total > every:
            raise ValueError("the archive is encrypted or too large")
        out.append((data[offset + 46 : offset + 46 + name].decode("utf-8", "replace"), size))
        offset += 46 + name + extra + comment
    return out
