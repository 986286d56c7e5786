"""Ordered rewriting of text: removing token spaces, and treebank tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The steps of the detokenizer, in order; ("text", from, to) or ("regex", pattern, replacement).
DETOKENIZE = [
    ("text", "s '", "s'"),
    ("regex", r"/' [0-9]/", r"/'[0-9]/"),
    ("text", " @-@ ", "-"),
    ("text", " @,@ ", ","),
    ("text", " @.@ ", "."),
    ("text", " : ", ": "),
    ("text", " ; ", "; "),
    ("text", " . ", ". "),
    ("text", "  . ", ". "),
    ("text", " ! ", "! "),
    ("text", " ? ", "? "),
    ("text", " , ", ", "),
    ("regex", r"\(\s*([^\)]*?)\s*\)", r"($1)"),
    ("regex", r"\[\s*([^\]]*?)\s*\]", r"[$1]"),
    ("regex", r"\{\s*([^}]*?)\s*\}", r"{$1}"),
    ("regex", r'"\s*([^"]*?)\s*"', r'"$1"'),
    ("regex", r"'\s*([^']*?)\s*'", r"'$1'"),
    ("text", "= = = =", "===="),
    ("text", "= = =", "==="),
    ("text", "= =", "=="),
    ("text", " ° ", "°"),
    ("text", " \n", "\n"),
    ("text", "\n ", "\n"),
    ("text", " N ", " 1 "),
    ("text", " 's", "'s"),
]

# Words that are split in two, clitics split off a word, and characters that are tokens alone.
CONTRACTIONS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "lemme": "lem me", "wanna": "wan na", "gimme": "gim me", "d'ye": "d 'ye", "more'n": "more 'n"}
FRONT_CONTRACTIONS = {"'tis": "'t is", "'twas": "'t was"}
SINGLE_CLITICS, DOUBLE_CLITICS = ["'s", "'m", "'d"], ["'ll", "'re", "'ve", "n't"]
ALONE, BRACKETS = ";@#%&$", "[](){}<>"

#: A private-use character that stands for a token boundary while rules run.
MARK = "\ue000"


def detokenize(column: Column) -> Column:
    """Undo the spaces that a tokenizer put around punctuation, contractions and headings."""
    for kind, a, b in DETOKENIZE:
        column = F.replace(column, F.lit(a), F.lit(b)) if kind == "text" else F.regexp_replace(column, a, b)
    return column


def treebank_marks(column: Column) -> Column:
    """Treebank token boundaries as marks: quotes, punctuation, brackets, dashes, clitics, contractions, spaces.

    A boundary in a rule's context is a mark, a space or an end of the text.  Quotes
    become two backticks when they open (after a boundary or bracket) and two
    apostrophes when they close.
    """
    m, sep, word = MARK, rf"(?=[{MARK} ]|\z)", rf"(?<=[^' {MARK}])"
    sep_apos, before = rf"(?=[{MARK} ']|\z)", rf"(?<![^{MARK} ])"
    rules = [
        (r"(?<=[ (\[{<])''", "``"),
        (r"\A''", "``"),
        (r"''", f"{m}''{m}"),
        (r'(?<=[ (\[{<])"', "``"),
        (r'\A"', "``"),
        (r'"', f"{m}''{m}"),
        (r"``", f"{m}``{m}"),
        (r"([:,])(?=[^0-9])", f"{m}$1{m}"),
        (r"([:,])\z", f"{m}$1{m}"),
        (r"\.\.\.", f"{m}...{m}"),
        (rf"([{ALONE}])", f"{m}$1{m}"),
        (rf"(?<=[^.])\.(?=[\])}}>'{m}]*\s*\z)", f"{m}."),
        (r"([?!])", f"{m}$1{m}"),
        (r"([\]\[(){}<>])", f"{m}$1{m}"),
        (r"--", f"{m}--{m}"),
        (rf"{word}('[smdSMD]){sep_apos}", f"{m}$1"),
        (rf"{word}('ll|'LL|'re|'RE|'ve|'VE|n't|N'T){sep_apos}", f"{m}$1"),
        (rf"{word}'{sep}", f"{m}'"),
    ]
    for words in (CONTRACTIONS, FRONT_CONTRACTIONS):
        for whole, parts in words.items():
            a, b = parts.split(" ")
            rules.append((rf"(?i){before}({a})({b}){sep_apos}", f"{m}$1{m}{m}$2{m}"))
    for pattern, to in rules:
        column = F.regexp_replace(column, pattern, to)
    return F.regexp_replace(column, " ", m)


def separators(column: Column, mark: str = MARK, to: str = MARK) -> Column:
    """Runs of marks as one separator."""
    return F.regexp_replace(column, f"{mark}+", to)


def treebank_tokens(column: Column) -> Column:
    """The tokens of a text, in order."""
    return F.filter(F.split(separators(treebank_marks(column)), MARK), lambda t: t != "")


def treebank_text(column: Column) -> Column:
    """The tokens joined by one space."""
    return F.array_join(treebank_tokens(column), " ")
