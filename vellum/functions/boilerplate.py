"""Patterns of what publishers print around a text: banners, page furniture, leaked front matter, watermarks.

Written in a short notation that ``full`` expands: ``_`` is white space, ``~`` optional white space, and the names in
angle brackets are the parts below. A line is furniture only if one pattern covers all of it.
"""

from __future__ import annotations

import re

PARTS = {
    "date": r"\d{1,2}\s+\w+\s+\d{4}",
    "anydate": r"(?:\w+\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+\w+\.?\s+\d{4})",
    "month": "(?:" + "|".join("January February March April May June July August September October November December".split()) + ")",
    "mail": r"\S+@\S+",
    "doi": r"10\.\d{3,5}/\S+",
    "Name": "[A-Z][A-Za-z]+",
    "place": r"[A-Z][\w\-]+(?:\s+[A-Z][\w\-]+)*",
    "pages": r"\d+[‐-―\-]\d+",
    "particle": "(?:(?:van|von|der|den|de|di|da|le|la|el|bin|ibn|dos|das|du)\\s+)*",
    "Surname": "[A-ZÀ-ÖØ-ÞĀ-ſ][A-Za-zÀ-ÖØ-öø-ÿĀ-ſ'’\\-]+",
}


def full(*patterns: str) -> tuple[str, ...]:
    """Regular expressions from the notation."""
    names = re.compile("<(" + "|".join(PARTS) + ")>")
    return tuple(names.sub(lambda m: PARTS[m[1]], p.replace("_", r"\s+").replace("~", r"\s*")) for p in patterns)


def whole(patterns: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns))


#: Banner lines, looked for at the head of a text.
BANNERS = full(
    r"(?:https?://)?(?:www\.)?\S+\.(?:ch|cn|com|de|edu|fr|gov|jp|net|nl|org|uk)(?:/\S*)?",
    "(?:HHS Public Access|Author manuscript|Article|ARTICLE|Research|Empirical Research Paper)",
    "(?:Published in final edited form as|Cite this article|Subject (?:Areas|Category)|Author for correspondence|To (?:cite|link to) this article):.*",
    "(?:Accepted|Received):_<date>.*",
    r"(?:Contents lists available at_\S+|View supplementary material|Full Terms.*Conditions of access).*",
    "(?i:journal homepage:.*)|(?i:article_type[.:]~.*)",
    r"ISSN:~\S+.*",
    r"arXiv:\d+\.\d+(?:v\d+)?_\[[\w.-]+\]_<date>",
    r"Original (?:Article|Investigation|Research)(?:~\|~.+)?",
    r"r_Academy of Management_\S.*\d{4},.*",
    r"[A-Z][A-Za-z &\-‐-―]{4,60}_\d{4},_Vol\._\d+(?:\(\d+\))?[\s,].+",
    r"[A-Z][A-Za-z &]{3,40}\._\d{4}.*\d+[:;].+doi:.*",
    r"[A-Z][A-Za-z &]{4,60}_\(\d{4}\),_\d+,_\d+.{0,200}",
    r".*Dhtt[Oo]ps[Ii]://.*",
    r"\d{6,}_[A-Z]{2,}[A-Z0-9]*\d+\.\d{4,}/.+|[A-Z]{2,}\d*10\.\d{4,}/\d{6,}[A-Z][a-z].*",
    r"(?i:[a-z][a-z\-]+,_\d{4},_vol(?:ume)?_\d+.*https?://doi\.org/.*)",
    r"[A-Z][A-Za-z &]+_\d+_\(\d{4}\)_\d+(?:_Contents.*)?",
    r"Digital Object Identifier_10\.\d+/.+|(?i:doi:?_<doi>)",
    "(?:Cognition and Emotion|Journal of Economic Psychology)",
    r"Journal of Experimental Social Psychology(?:_\d+(?:~\(\d{4}\))?_<pages>)?",
    r"<Name>(?:_[A-Za-z]+){1,8},_Vol\._\d+,_No\._\d+,_\w+_\d{4},_pp\._<pages>",
    r"<Name>(?:_[A-Za-z]+){0,3},_\d{4},_\d+,_<pages>",
    r"https?://doi\.org/\S+_Advance access.*",
)

#: Lines that are furniture wherever they stand.
FURNITURE = full(
    r"Page_\d+|\d{1,3}~/~\d{1,3}|\([Cc]ontinued\)|a1{8,}|Vol\.:\(\d{10,}\)",
    r"<month>(?:_\d{1,2},~20\d{2}(?:_\d+/\d+)?)?",
    "[a-z][A-Z][A-Za-z]+(?:_[A-Z][A-Za-z]+)*",
    "Corresponding_[Aa]uthors?:.*|(?i:Author_for_correspondence:.*)",
    r"(?i:E-?mails?:~\S+@.+|Tel(?:\.|ephone)?:~\S.*|Fax:~\S.*)",
    r"(?i:E-?mail_addresses?:~<mail>(?:[\s,;]+<mail>)*)",
    r"[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,6}(?:[\s,;]+[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,6})*",
    r"JAMA_Network_Open(?:\._20\d{2};\d+\(\d+\):e\d+\.~doi:10\.\d+/.+|_\|_\S.*)",
    "(?i:Article_reuse_guidelines:?)",
    r"Open_Access(?:\._This is an open access article.*doi:10\.\d+/.+)?",
    r"©~20\d{2}\b.*|(?i:\(c\)~20\d{2}\b.*)",
    r"Author affiliations and article information are listed at the end of (?:the|this) article\.?",
    r"\+~(?:Visual Abstract.*)?Supplemental content",
    r"Received:_[\w ,]+\d{4}\._(?:Revised:.*)?Accepted:.*©.*",
    r"(?i:\(Received_<date>;_(?:accepted|revised).*\))",
    r"(?i:©_The Author\(s\)[,\s]+\d{4}\..*(?:Cambridge University Press|Published by ).*)",
    "(?i:This is an open access article distributed under.*|ELECTRONIC SUPPLEMENTARY MATERIAL\\b.*)",
    r"\S[^|\n]{2,80}\|~\d{1,4}",
    r"\d{1,4}_[A-ZÀ-ÿ][^\n]{1,60}_et al\.?",
    r"[A-Z]\.(?:~[A-Z]\.?)?_[A-Z]{2,}_ET_AL\.?|[A-Z]{2,}(?:_[A-Z]{2,}){0,3}_et_al\.?",
    r"<particle><Surname>(?:_<particle><Surname>){0,2}_et_al\.?",
    r"(?i:Submit your article to this journal|View related articles?|View Crossmark data|Citing articles?:_\d+_View citing articles?)",
    r"(?i:Published online:?_<date>\.?|Full Terms_&?_Conditions of access and use\.?)",
    "ARTICLE HISTORY|(?:Accepted|Received|Revised)_<date>",
    r"(?i:Supplemental_data_for_this_article_can_be_accessed_(?:here|online|via)\.?)",
    "Department_of_<Name>(?:_and_[A-Z][A-Za-z\\s]+?)?,~University_of",
    "Department_of_<Name>(?:_and_<Name>)?,_University_of_<Name>(?:_Kong)?,_.{2,80}",
    r"University_of_<Name>(?:_<Name>)?,_<Name>(?:_[A-Z][\w\-]+)*,_[A-Z][\w\s]{1,40}\.?",
    r"[A-Z][\w\-]+(?:_[A-Z][\w\-]+){0,3},_Department_of_<Name>(?:_and_<Name>)?,_University_of_<Name>(?:_<Name>)?,_.{2,80}\.?",
    r"CONTACT_[A-Z][\w'’-]+(?:_[A-Z][\w'’-]+)+_<mail>.*",
    r"[a-z]_(?:Contributed_equally|Corresponding_[Aa]uthor|(?:Joint|Shared)_first_author)\b.*",
    r"rsos\.royalsocietypublishing\.org|www\.nature\.com/(?:naturecommunications|scientificreports)",
    r"https?://orcid\.org/\d{4}-\d{4}-\d{4}-[0-9X]{4}|(?i:https?://(?:dx\.)?doi\.org/<doi>)|(?i:doi:~<doi>)",
    r"(?i:Copyright_of_the_Academy_of_Management,.*rights_reserved\.?.*)",
    "ARTICLE_HISTORY_Received_<date>(?:_Revised_<date>)?_Accepted_<date>",
    r"(?:https?://doi\.org/\S+_)?Received_<date>;.*(?:©|All_rights_reserved\.?).*",
    r"(?i:Received:?_<date>~[;,]~Accepted:?_<date>(?:~[;,]~Published:?_<date>)?~\.?)",
    r"(?i:Received_<anydate>~;~revision_accepted_<anydate>~\.?)",
    r"(?:Competing_[Ii]nterests?|Conflicts?_of_[Ii]nterest)~[:.]~(?:None|The_authors?_declare).*",
    r"Abbreviations:_\S.+",
)
#: A running head of two authors of one surname; a language without references back leaves it out.
TWINS = re.compile(r"([A-Z][a-z]+) and \1")

CONTACT = re.compile("".join(full("CONTACT_(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ][\\w'’\\-]*|[A-ZÀ-ÖØ-Þ]\\.?)(?:[\\s'’\\-]+(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ][\\w'’\\-]*|[A-ZÀ-ÖØ-Þ]\\.?)){1,3}")))
NO_NAME = re.compile(r"(?i)\b(?:address|authors?|below|details?|editor|form|here|info|information|page|support|team|us)\b")
REGION = re.compile("".join(full(r"[A-ZÀ-ÖØ-Þ][\w'’\-]*(?:_[A-ZÀ-ÖØ-Þ]?[\w'’\-]+){0,3},~[A-ZÀ-ÖØ-Þ][\w'’\-]*(?:_[\w'’\-]+){0,3}\.?")))

#: Lines that leak from the front matter into the first part of a text: whole lines, and how longer ones begin.
LEAKED = full(
    r"[A-Z][a-z]+(?:_[A-Z][a-z]+){0,2},_(?:[A-Z][a-z]+(?:_[A-Z][a-z]+){0,2}(?:_[A-Z]{2,5})?|[A-Z]{2,5}(?:_\d{4,5}(?:-\d{4})?)?)\.",
    "(?i:(?:brief|case|commentary|editorial|empirical|invited|letter|meta-analysis|opinion|original|perspective|practice|research|review|short|systematic-review)-(?:article|communication|note|paper|report|review|study)[0-9]{4})",
    r"\d{6,8}",
    r"[A-Z][\w\-]+(?:_[A-Z][\w\-]+){0,3},_Department_of_<Name>(?:_(?:and|of)_<Name>)?,_University_of_[A-Z][\w\s]+,_[A-Z][\w\s]+,_[A-Z][\w\s]+\.?",
    r"(?i:We_(?:wish_to_)?thank_[a-z].{0,300}?\b(?:comments?|editor|feedback|helpful|insights?|reviewers?|suggestions?)\b.*)",
    r"(?i:A_previous_version_of_this_article_was_(?:presented|published)\b.*)",
    r"(?i:This_work_is_licensed_under_(?:a_|the_)?Creative_Commons\b.*)",
    r"(?i:Correspondence_concerning_this_article_should_be_addressed_to\b.*)",
)
AFFILIATION_CHARS, LEAK_CHARS = 60, 1500

#: Stamps inside lines; each is deleted.
WATERMARKS = full(
    r"(?i:Downloaded_from_https?://\S+(?:_by_[^\n]+?)?_on_<date>)",
    r"(?i:Downloaded_from_[\w.-]+\.\w{2,}(?:_by_[^\n]+?)?_on_\d{1,2}/\d{1,2}/\d{4})",
    r"(?i:Provided_by_[\w\s.,&-]+_on_\d{4}-\d{2}-\d{2})",
    r"(?i:This_article_is_protected_by_copyright\.[^\n]*)",
    r"\d{1,6}~royalsocietypublishing\.org/journal/\w+_R\.~Soc\.~Open~Sci\.~\d+:~\d+",
    r"(?m:^~[©Ó]~\d{4}[^\n]*?(?i:All_rights_reserved)\.?~\n?)",
    r"(?m:^~\d{4}-\d{3}[\dX]/[^\n]*?(?i:see_front_matter|Elsevier|All_rights_reserved)[^\n]*\n?)",
    r"(?m:^~(?i:E-mail_address:)~\S*@\S+[^\n]*\n?)",
    r"(?m:^~[A-Z]\.~(?:[A-Z]\.~)?[A-Z][\w'\-]+(?:~(?:and|&|,)~[A-Z]\.~(?:[A-Z]\.~)?[A-Z][\w'\-]+)*~/~[A-Z][^/\n]{2,80}?_\d+~\(\d{4}\)_\d+~[-–]~\d+~\n?)",
    r"(?m:^~[a-z]_(?:[A-Z][\w-]+,_(?:and_)?){2,15}[A-Z][\w-]+_(?:are_)?(?:equal[ -]?contribution|joint_first_author)[^\n]*\n?)",
    r"(?:Copyright[: ]~[©Ó]?~\d{4}\.?_)?The authors? licen[cs]e this article under the terms of the_Creative_Commons[^\n]*?License\.?",
    r"(?i:(?:https?://doi\.org/\S+_)?Published_online_by_Cambridge_University_Press)",
    r"(?i:(?:Association for Decision Making\.~)?This is an Open Access article,[\s\S]{0,60}?distributed under the terms of the_Creative_Commons[\s\S]{0,240}?properly cited\.)",
)
#: Of each stamp parts, in lower case, of which a text must hold one.
STAMPED = (("downloaded",), ("downloaded",), ("provided",), ("protected",), ("royalsociety",), ("reserved",), ("front", "elsevier", "reserved"), ("e-mail",), (" / ", "/ ", "/\n"), ("contribution", "first"), ("commons",), ("cambridge",), ("open access article",))

#: Shapes of running heads, beside the banner of capitals.
HEADS = full(
    r"(?:\d{1,4}_)?(?:[A-Z]\.~)*[A-Z]{2,}(?:_[A-Z]\.)*_AND_(?:[A-Z]\.~)*[A-Z]{2,}(?:_[A-Z]\.)*",
    "[A-Z][a-z]{1,25}_(?:and|&)_[A-Z][a-z]{1,25}",
    r".{3,60}\|~https?://doi\.org/\S+(?:_\S+(?:_\d{1,2},?~\d{4})?)?",
    r"[A-Z][A-Za-z][A-Za-z &\-]{4,60}_\d{1,3}\(\d{1,3}\)",
    r"(?:.{2,45}_/_)?[A-Z][A-Za-z][A-Za-z&\-:' ]{5,70}_\d{1,4}_\(\d{4}\)_(?:\d{1,7}|\d{1,5}~[–-]~\d{1,5})",
    r"[A-Z][A-Za-z][A-Za-z&\-:' ]{1,50}~\|~\(\d{4}\)\d{1,4}:\d{1,7}(?:~\|~\S.*)?",
    r"(?:[A-Z]\.[-\s]*){1,4}(?:(?:ben|bin|da|de|del|della|den|der|di|dos|du|el|la|le|van|von)_){0,2}[A-ZÀ-Þ][\w'’\-]+_et_al\.?",
    "Articles?|ARTICLE|Reviews?|REVIEW|Letters?|LETTER|Resources?|Analysis|Perspectives?|Correspondence|Editorial|Brief_Communication|Matters_Arising",
    "Original_(?:Article|Investigation|Research)|Research_(?:Article|Letter|Paper|Report)",
)
CAPITALS = re.compile("[A-Z][A-Z &.-]*")

#: Compounds that lose their hyphen at a line's end: what stands before the gap, and what after.
COMPOUNDS = {
    "experi": "ments? mental mentally ences? enced mentation",
    "addi": "tions? tionally tives?",
    "discre": "panc(?:y|ies) tion tionary",
    "con": "cerning ducted ducting fined firmed firmation sequently sistent(?:ly)? cluded sists sisted siderabl[ey] troll(?:ed|ing) fronted",
    "ques": "tions? tionnaires? tioned tioning",
    "presenta": "tions? tional",
    "discus": "sions? sed",
    "informa": "tions? tional tive",
    "differ": "ences? ent ently ential entiated?",
    "repli": "cations? cate[sd]? cating",
    "refer": "ences? ential enced encing",
    "identi": "fied fies fy fication",
    "specifi": "cations? cally ed",
    "reliabi": "lity lities",
    "genera": "tions? lly lized? lization",
    "explana": "tions? tory",
    "transla": "tions? ted ting",
    "observa": "tions? tional",
    "opera": "tions? tional tionalized?",
    "varia": "tions? bles? bility",
    "correla": "tions? tional ted ting",
    "applica": "tions? bles? bility",
    "interpre": "tations? t ted ting tive",
}

#: The Symbol font's characters from 0x20 and from 0xA1; NUL where it has none.
SYMBOL_LOW = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_HIGH = "ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…\0\0↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊⟨®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪\0⟩∫⌠\0⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"


def symbol_font() -> dict[str, str]:
    """Private code points that a Symbol font leaves, and the character each shows."""
    out = {chr(0xF020 + i): c for i, c in enumerate(SYMBOL_LOW)}
    out |= {chr(0xF0A1 + i): c for i, c in enumerate(SYMBOL_HIGH) if c != "\0"}
    return out | {chr(0xF8EE + i): chr(0x23A1 + i) for i in range(3)} | {chr(0xF8F9 + i): chr(0x23A4 + i) for i in range(3)}
