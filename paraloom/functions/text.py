"""Text and HTML functions: sanitising, tokens, HTML to text, links, structure, decoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that start and end a line, by the HTML standard and by use.
LINE_ELEMENTS = [
    "address", "article", "aside", "audio", "blockquote", "br", "canvas", "dd", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "li", "noscript", "ol", "option", "output", "p", "pre", "section", "table", "tfoot", "tr", "ul", "video",
]
#: Elements that add a space on both sides, and elements whose content is no text.
SPACE_ELEMENTS, HIDDEN_ELEMENTS = ["th", "td", "span"], ["script", "style", "noscript"]
#: Entities that the expression form decodes.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def clean_whitespace(text: Column, separator: str = "\n") -> Column:
    """Lines trimmed, empty ones dropped, runs of white space made one blank."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), separator)


def clean_characters(text: Column) -> Column:
    """Control, format and separator characters become blanks; line feeds stay."""
    return F.regexp_replace(text, r"[\p{C}\p{Z}&&[^\n]]", " ")


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Normal form C."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def clean_text(text: Column, sanitize: bool = True, whitespace: bool = True) -> Column:
    out = clean_characters(text) if sanitize else text
    return clean_whitespace(out) if whitespace else out


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def wordpunct_tokens(text: Column) -> Column:
    """Runs of word characters, and runs of other characters that aren't white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def bag_words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    trimmed = F.transform(wordpunct_tokens(F.lower(text)), lambda t: F.regexp_replace(t, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def sentences(text: Column) -> Column:
    """Default sentence splitter: after . ! ? and a blank, and at line ends."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), lambda s: F.trim(s)), lambda s: s != "")


def html_to_text(html: Column, ignore_br: bool = False) -> Column:
    """HTML to text by expressions only: hidden elements and comments go, line elements break, tags go, entities are decoded."""
    x = html
    for name in HIDDEN_ELEMENTS:
        x = F.regexp_replace(x, f"(?is)<{name}\\b[^>]*>.*?</{name}\\s*>", " ")
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    spaced = [*SPACE_ELEMENTS, *(["br"] if ignore_br else [])]
    broken = [e for e in LINE_ELEMENTS if e not in HIDDEN_ELEMENTS and not (ignore_br and e == "br")]
    x = F.regexp_replace(x, f"(?i)</?(?:{'|'.join(broken)})(?:\\s[^>]*)?/?>", "\n")
    x = F.regexp_replace(x, f"(?i)</?(?:{'|'.join(spaced)})(?:\\s[^>]*)?/?>", " ")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for entity, character in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(character))
    return clean_whitespace(x)


class _Text(HTMLParser):
    def __init__(self, ignore_br: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.broken = set(LINE_ELEMENTS) - ({"br"} if ignore_br else set())
        self.spaced = set(SPACE_ELEMENTS) | ({"br"} if ignore_br else set())
        self.out, self.hidden = [], ""

    def _tag(self, tag: str) -> None:
        if not self.hidden:
            self.out.append("\n" if tag in self.broken else " " if tag in self.spaced else "")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not self.hidden and tag in HIDDEN_ELEMENTS:
            self.hidden = tag
        self._tag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == self.hidden:
            self.hidden = ""
        self._tag(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def parsed_html_to_text(ignore_br: bool = False, sanitize: bool = False) -> Callable[[Column], Column]:
    """HTML to text with a parser, for malformed pages; an Arrow-batched function."""

    def one(html: str | None) -> str | None:
        if html is None:
            return None
        parser = _Text(ignore_br)
        parser.feed(html)
        parser.close()
        text = "".join(parser.out)
        if sanitize:
            text = "".join(" " if unicodedata.category(c)[0] in "CZ" and c != "\n" else c for c in unicodedata.normalize("NFC", text))
        lines = (" ".join(line.split()) for line in text.split("\n"))
        return "\n".join(line for line in lines if line)

    return F.pandas_udf(lambda s: s.map(one, na_action="ignore"), "string")


class _Sequence(HTMLParser):
    def __init__(self, length: Callable[[str], int], growth: Callable[[int], float]) -> None:
        super().__init__(convert_charrefs=True)
        self.length, self.growth, self.out = length, growth, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.out.append(f"<{tag}>")

    def handle_endtag(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if n := self.length(data):
            self.out += map(str, range(int(self.growth(n))))


def tag_sequence(length: Callable[[str], int] = lambda s: len(s.split()), growth: Callable[[int], float] = lambda n: 1 + math.log(n)) -> Callable[[Column], Column]:
    """The tags of a page, each text between them as 0 .. growth(length)-1."""

    def one(html: str) -> list[str]:
        parser = _Sequence(length, growth)
        parser.feed(html or "")
        parser.close()
        return parser.out

    return F.pandas_udf(lambda s: s.map(one), "array<string>")


def links(html: Column, tag: str = "a", attribute: str = "href") -> Column:
    """Values of an attribute of a tag, in order: //a/@href or //img/@src."""
    return F.regexp_extract_all(html, F.lit(f"(?i)<{tag}\\b[^>]*?\\b{attribute}\\s*=\\s*[\"']\\s*([^\"']*)[\"']"), F.lit(1))


def hrefs(html: Column) -> Column:
    """Distinct values of any href."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("href\\s*=\\s*['\"]\\s*([^'\"]+)['\"]"), F.lit(1)))


def decoded(default: str = "latin-1") -> Callable[[Column, Column], Column]:
    """Bytes to text: strict UTF-8, then the declared character set, then a guess, then the default."""

    def one(data: bytes | None, declared: str | None) -> str | None:
        if data is None:
            return None
        for name in ("utf-8", declared):
            try:
                return bytes(data).decode(name) if name else bytes(data).decode("utf-8")
            except (UnicodeDecodeError, LookupError):
                continue
        try:
            from charset_normalizer import from_bytes
        except ImportError:
            return bytes(data).decode(default, "ignore")
        best = from_bytes(bytes(data)).best()
        return str(best) if best else bytes(data).decode(default, "ignore")

    return F.pandas_udf(lambda data, declared: pd.Series([one(d, c) for d, c in zip(data, declared, strict=True)]), "string")


def declared_charset(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?i)charset\s*=\s*[\"']?\s*([\w-]+)", 1))


def repaired_latin(text: Column) -> Column:
    """Text whose UTF-8 bytes were once read as Latin-1, read right; other text stays."""
    ok = text.rlike("^[\\x00-\\xff]*$")
    again = F.try_validate_utf8(F.encode(F.when(ok, text), "ISO-8859-1").cast("string"))
    return F.coalesce(again, text)
