"""Streams of XML elements: only wanted elements are built, everything else is passed over, and document types are refused wherever they stand."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from xml.etree.ElementTree import Element
from xml.parsers import expat

CHUNK = 1 << 16
#: Characters of one built element.
MAX_ELEMENT = 8 << 20


def local(name: str) -> str:
    return name.rpartition(" ")[2]


def scan(stream: BinaryIO, wanted: set[str], opened: frozenset[str] = frozenset()) -> Iterator[tuple[str, Element]]:
    """("element", e) for each wanted element as it ends, outermost ones only, and ("open", e), without children, for each of ``opened`` as it begins.

    The stream is read as far as the caller goes on. Names of ``opened`` are not looked for inside wanted elements.
    """
    found: list[tuple[str, Element]] = []
    path: list[Element] = []
    size = 0

    def refuse(*_):
        raise ValueError("document types are refused")

    def start(name, attributes):
        nonlocal size
        tag = name.replace(" ", "}") if " " in name else name
        tag = "{" + tag if " " in name else tag
        if path or local(name) in wanted:
            element = Element(tag, {("{" + k.replace(" ", "}") if " " in k else k): v for k, v in attributes.items()})
            size = sum(map(len, attributes.values())) + (size if path else 0)
            if path:
                path[-1].append(element)
            path.append(element)
        elif local(name) in opened:
            found.append(("open", Element(tag, {("{" + k.replace(" ", "}") if " " in k else k): v for k, v in attributes.items()})))

    def end(name):
        if path:
            element = path.pop()
            if not path:
                found.append(("element", element))

    def text(data):
        nonlocal size
        if path:
            size += len(data)
            if size > MAX_ELEMENT:
                raise ValueError("an element exceeds its limit")
            last = path[-1]
            if len(last):
                last[-1].tail = (last[-1].tail or "") + data
            else:
                last.text = (last.text or "") + data

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartDoctypeDeclHandler = refuse
    parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    while True:
        data = stream.read(CHUNK)
        try:
            parser.Parse(data, not data)
        except expat.ExpatError as error:
            raise ValueError(f"damaged XML: {error}") from None
        yield from found
        found.clear()
        if not data:
            return
