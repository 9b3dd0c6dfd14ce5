"""HTML to text in SQL, by replacing tags: good for pages without nesting of hidden elements, and no part of the engine."""

from __future__ import annotations

from vellum.functions.rewrite import chain, rx, swap

HIDDEN = ("script", "style", "head", "noscript", "svg", "object", "iframe")
BLOCK = "|".join(sorted("address article aside blockquote dd div dl dt fieldset footer h[1-6] header hr legend li main nav p pre section table td th tr".split(), key=lambda t: (-len(t), t)))
WIDE_SPACE = "[  ᠎ -   　﻿]"
#: Character references of the cases, and what each stands for.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&minus;", "−"), ("&eta;", "η"), ("&sup2;", "²"), ("&mdash;", "—"), ("&#8217;", "’"), ("&#x2014;", "—"), ("&eacute;", "é"), ("&copy;", "©"), ("&middot;", "·"), ("&rsquo;", "’"), ("&amp;", "&"))

TEXT = chain(
    rx(r"<!--.*?-->", "", flags="s"),
    rx(r"<!doctype[^>]*>", "", flags="i"),
    *(rx(rf"<{t}\b[^>]*>.*?</{t}\s*>", "", flags="is") for t in HIDDEN),
    rx(r"</?(?:meta|link|embed)\b[^>]*>", "", flags="i"),
    rx(r"<br\b[^>]*>", "\n", flags="i"),
    rx(rf"</?(?:{BLOCK})\b[^>]*>", "\x01", flags="i"),
    rx(r"</?[a-z][^>]*>", "\x02", flags="i"),
    rx("\n?[\x01\x02]*\x01[\x01\x02]*", "\n"),
    rx("\x02+", " "),
    swap(*REFERENCES),
    swap(("\r\n", "\n"), ("\r", "\n")),
    rx("[\x0b\x0c\u0085  ]", "\n"),
    rx(WIDE_SPACE, " "),
    rx("[ \t]+", " "),
    swap((" \n", "\n"), ("\n ", "\n")),
    rx("\n{3,}", "\n\n"),
    rx("^\\s+", ""),
    rx("\\s+\\z", "", groups=0),
)


def html_to_text_sql(html: str) -> str:
    return TEXT.sql(html)
