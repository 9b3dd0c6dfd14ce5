"""Queries of text operators against results written by hand: a case chosen by the id stands before each whole text.

Operator and text meet as in use, and what comes out before the mark is compared. The results aren't made by
the operators' own patterns, so a wrong pattern shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.corpus import pick, pick_sql, read

MARK = "\n\n@@ the text @@\n\n"
Case = tuple[str, str]


def before_texts(spark: SparkSession, sf_dir: str, f: Callable[[Column], Column], cases: tuple[Case, ...]) -> DataFrame:
    """``(doc_id, text)``: what ``f`` makes of a case that a whole text follows, up to the mark."""
    docs = read(spark, sf_dir, "documents")
    whole = F.concat(pick(tuple(c[0] for c in cases)), F.lit(MARK), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", f(whole).alias("t")).select("doc_id", F.rtrim(F.split_part("t", F.lit(MARK.strip()), F.lit(1)), F.lit("\n ")).alias("text"))


def expected_sql(cases: tuple[Case, ...]) -> str:
    return f"SELECT doc_id, {pick_sql(tuple(c[1] for c in cases))} AS text FROM documents"


PROSE = ("The people who took part were asked about what they had seen. " * 4).strip()

#: Input, result at the standard level, result at the academic level.
NORMALIZED: tuple[tuple[str, str, str], ...] = (
    ("It was p\n= .03 and 95%\nCI [0.1; 0.5] here.", "It was p\n= .03 and 95%\nCI [0.1; 0.5] here.", "It was p = .03 and 95% CI [0.1, 0.5] here."),
    ("eﬀect ﬁnd oﬃce.", "effect find office.", "effect find office."),
    ("“a” ‘b’ −0.73 – 1—2.", "\"a\" 'b' -0.73 - 1--2.", "\"a\" 'b' -0.73 - 1--2."),
    ("N = 1,234,567,890 and 12,345,678 people.", "N = 1,234,567,890 and 12,345,678 people.", "N = 1234567890 and 12345678 people."),
    ("F[1, 30] = 4.2, p = 484; η² = .12.", "F[1, 30] = 4.2, p = 484; η² = .12.", "F(1, 30) = 4.2, p = .484; eta2 = .12."),
    ("It was large (p < 05), and so on.", "It was large (p < .05), and so on.", "It was large (p < .05), and so on."),
    ("Contents lists available at ScienceDirect\nA study of things\nReceived: 4 May 2019 in form\nBody text stands here.", "A study of things\nBody text stands here.", "A study of things\nBody text stands here."),
    ("Page 12\nThe people were\n© 2021 The Authors\nasked twice.", "The people were asked twice.", "The people were asked twice."),
    ("the experi mental repli\ncations and ques tionnaires.", "the experimental replications and questionnaires.", "the experimental replications and questionnaires."),
    ("caf´e, f¨ur, e ́tude.", "café, für, étude.", "café, für, étude."),
    ("signi­\nficant result​  here.", "significant result here.", "significant result here."),
    ("b = 20.45, 95% CI [-0.60, -0.30].", "b = -0.45, 95% CI [-0.60, -0.30].", "b = -0.45, 95% CI [-0.60, -0.30]."),
    ("the effect [20.92, 20.30] held.", "the effect [-0.92, -0.30] held.", "the effect [-0.92, -0.30] held."),
    ("An interaction (Age 3 Sex) mattered.", "An interaction (Age × Sex) mattered.", "An interaction (Age x Sex) mattered."),
    ("a b s t r a c t\nWe ran it.", "abstract\nWe ran it.", "abstract\nWe ran it."),
    ("2.1.\n\nMethods\n\nWe ran it.", "2.1. Methods\n\nWe ran it.", "2.1. Methods\n\nWe ran it."),
    ("See doi:10.1037.\n001 for it.", "See doi:10.1037.\n001 for it.", "See doi:10.1037.001 for it."),
    ("Downloaded from https://host.org/1 by guest on 4 May 2020\nIt goes on.", "It goes on.", "It goes on."),
    ("α = .8, x ≤ 3 and R² = .5.", "α = .8, x ≤ 3 and R² = .5.", "alpha = .8, x <= 3 and R2 = .5."),
    ("[0.81; 1.92] and {0.1, 0.2} ( .3 ; .4 ).", "[0.81; 1.92] and {0.1, 0.2} ( .3 ; .4 ).", "[0.81, 1.92] and [0.1, 0.2] (.3, .4)."),
    ("It was 0,05 and (0,25).", "It was 0,05 and (0,25).", "It was 0.05 and (0.25)."),
    ("�2 = .12 and  = .3.", "eta2 = .12 and β = .3.", "eta2 = .12 and beta = .3."),
    ("Table of Contents\n\n1 Start ____ 3\n\nBody text.", "Body text.", "Body text."),
    ("COGNITION AND EMOTION\nFirst line.\nCOGNITION AND EMOTION\nSecond line.\nCOGNITION AND EMOTION\nThird line.", "First line.\nSecond line.\nThird line.", "First line.\nSecond line.\nThird line."),
    ("It is one.\n12\nIt is two.", "It is one.\n\nIt is two.", "It is one.\n\nIt is two."),
    ("CONTACT Jane Doe\n\nLeeds, West Yorkshire\nThe text goes on.", "The text goes on.", "The text goes on."),
    ("We wish to thank Ann Lee and two reviewers for their comments.\n" + PROSE, PROSE, PROSE),
    ("t(87) = 2.1,\n\np < .05 there.", "t(87) = 2.1,\n\np < .05 there.", "t(87) = 2.1, p < .05 there."),
    ("x ≥ 5 and y � 5.", "x ≥ 5 and y ≤ 5.", "x >= 5 and y <= 5."),
    ("They ob-\nserved Smith-\nJones and\nthe rest.", "They observed Smith-\nJones and the rest.", "They observed Smith-\nJones and the rest."),
    ("The people (N = 484) of p = 5 and F(1,300) = 15.8.", "The people (N = 484) of p = 5 and F(1,300) = 15.8.", "The people (N = 484) of p = 5 and F(1, 300) = 15.8."),
)

BANNERS: tuple[Case, ...] = (
    ("https://www.journal.com/x\nA Title\nHHS Public Access", "A Title"),
    ("A Title\nISSN: 1234-5678\nCite this article: Lee 2019\nFirst words.", "A Title\nFirst words."),
    ("arXiv:1901.01234v2 [cs.CL] 4 May 2019\nDOI: 10.1111/abc.12\nThe Title", "The Title"),
    ("## Results\nArticle\nHHS Public Access", "## Results\nArticle\nHHS Public Access"),
    ("Social Forces, 2025, 104, 224–249\nOriginal Article | Health\nA Title", "A Title"),
    ("We read the Article\nand Research on it", "We read the Article\nand Research on it"),
)
FURNITURE: tuple[Case, ...] = (
    ("One.\n3/12\nTwo.\nPage 3\nThree.", "One.\nTwo.\nThree."),
    ("Fax: 12 34\nE-mail: a@b.org\nCorresponding Author: Lee\nText.", "Text."),
    ("Lee and Lee\nLee and Kim\nText.", "Lee and Kim\nText."),
    ("CONTACT Jane Doe\nLeeds, West Yorkshire\nText.", "Text."),
    ("CONTACT Us Today\nLeeds, West Yorkshire\nText.", "CONTACT Us Today\nLeeds, West Yorkshire\nText."),
    ("Leeds, West Yorkshire\nText.", "Leeds, West Yorkshire\nText."),
    ("M. MUSTERMANN ET AL.\nvan der Berg et al.\nText et al. say so.", "Text et al. say so."),
    ("Competing interests: None declared\nAbbreviations: CI, interval\nThis is text.", "This is text."),
)
LEAKS: tuple[Case, ...] = (
    ("Hong Kong, Hong Kong SAR.\n" + PROSE, PROSE),
    ("research-article2019\n1234567\n" + PROSE, PROSE),
    ("A previous version of this article was presented at a meeting.\n" + PROSE, PROSE),
    ("Atlanta, Georgia\n" + PROSE, "Atlanta, Georgia\n" + PROSE),
    ("This work is licensed under a Creative Commons licence.\nCorrespondence concerning this article should be addressed to Lee.\n" + PROSE, PROSE),
)
CONTENTS: tuple[Case, ...] = (
    ("Table of Contents\n\n1 Start ____ 3\n\nBody text", "Body text"),
    ("Intro\n\nMethods ________ 4\n\nmore", "Intro\n\nmore"),
    ("nothing\n\nof_that kind", "nothing\n\nof_that kind"),
    ("## Methods\n\nMethods ___ 4\n\nList of Tables\n\nmore", "more"),
)
HEADS: tuple[Case, ...] = (
    ("J. Smith et al.\nOne\nJ. Smith et al. then two\nJ. Smith et al.\nJ. Smith et al.", "One\nthen two"),
    ("PLOS MEDICINE\nOne\nPLOS MEDICINE\nTwo\nPLOS MEDICINE, three", "PLOS MEDICINE\nOne\nPLOS MEDICINE\nTwo\nPLOS MEDICINE, three"),
    ("Lee and Kim\nLee and Kim\nLee and Kim, four\nLee and Kim", "four"),
    ("Body words\nBody words\nBody words", "Body words\nBody words\nBody words"),
    ("Cognitive Psychology 12 (2020) 100-120\na\nCognitive Psychology 12 (2020) 100-120\nb\nCognitive Psychology 12 (2020) 100-120\nCognitive Psychology 12 (2020) ", "a\nb"),
)
CLUSTERS: tuple[Case, ...] = (
    ("a\n1401\nb\n1402\nc\n1403\nd", "a\n\nb\n\nc\n\nd"),
    ("a\n1990\nb\n1990\nc\n1990\nd", "a\n1990\nb\n1990\nc\n1990\nd"),
    ("a\n3000\nb\n3000\nc\n3000\nd", "a\n\nb\n\nc\n\nd"),
    ("a\n1401\nb\n1409\nc\n1420\nd", "a\n1401\nb\n1409\nc\n1420\nd"),
)
PAGES: tuple[Case, ...] = (
    ("we saw the\nFive of\nSix more here\nSeven of it here\nEight so here\nNine yes here\nTen no here\nEleven up here\nTwelve\fplain page", "1"),
    ("only one page of prose.", ""),
    ("plain.\fone here\nTwo here\nThree here\nFour here\nFive here\nSix here\nSeven here", "2"),
)
