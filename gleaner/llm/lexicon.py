"""Closed-class words of the five languages, the languages' codes and names, and word classes."""

from __future__ import annotations

import re

LANGS = ("en", "de", "fr", "es", "it")

# Closed-class words (articles, pronouns, prepositions, conjunctions, auxiliaries) in lower case.
FUNCTION_WORDS = {
    "en": "a an the this that these those it its he she they we you i his her their our your my and or but nor so yet if "
    "because while although than as of in on at by to from with without for into over under behind near across during "
    "after before since until is are was were be been has have had do does did will would can could may must shall "
    "not no who which what when where how there here some any every each all both many much few more most other such one",
    "de": "der die das den dem des ein eine einen einem einer eines dieser diese dieses und oder aber sondern denn doch "
    "weil wenn ob dass als wie von vom zu zum zur in im an am auf aus bei beim mit nach seit für durch gegen ohne um "
    "über unter vor hinter neben zwischen bis ist sind war waren wird werden hat haben hatte kann muss soll nicht kein "
    "keine keinen er sie es wir ihr ich uns sich man seine ihre was wer wo auch noch nur schon sehr so da hier jede jeder jedes",
    "fr": "le la les l un une des du de d au aux ce cet cette ces et ou mais donc car ni que qui quoi dont où si comme "
    "parce puisque pour par sur sous dans en avec sans chez vers entre depuis jusqu pendant avant après est sont était "
    "être a ont avait avoir fait ne n pas plus rien je tu il elle on nous vous ils elles se s son sa ses leur leurs notre "
    "votre y aucun aucune tout tous toute quand alors même aussi très",
    "es": "el la los las lo un una unos unas de del al a ante con contra desde durante en entre hacia hasta para por "
    "según sin sobre tras y e o u pero sino aunque porque pues que quien cual cuando donde como si no ni es son era "
    "fue ser está están hay ha han había se su sus mi tu le les nos me te yo él ella ellos este esta estos estas ese esa "
    "ningún ninguna muy más también ya todo toda todos cada",
    "it": "il lo la i gli le l un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla in "
    "nel nella nei nelle con su sul sulla per tra fra e ed o ma però perché poiché che chi cui quando dove come se non "
    "né è sono era essere ha hanno aveva si ci vi ne lo mi ti suo sua suoi sue questo questa questi quello quella nessun "
    "nessuna più anche già molto ogni tutti fino senza dopo prima",
}
FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
ANY_FUNCTION = frozenset().union(*FUNCTION.values())

# Codes and names under which labels give the five languages.
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglese",
    "de": "de deu ger deutsch german allemand alemán aleman tedesco",
    "fr": "fr fra fre french français francais französisch francés frances francese",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo",
    "it": "it ita italian italiano italienisch italien",
}
LABEL_TO_LANG = {name: lang for lang, names in LABELS.items() for name in names.split()}
MISSING_LABELS = frozenset({"", "unknown", "und", "n/a", "na", "none", "null"})

# Inside a word any other non-ASCII sign counts as part of it, so that wrongly decoded words stay one token.
LETTER, ODD, DIGIT, MARK = r"[^\W\d_]", r"[^\x00-\x7f\s“”„’‘–—…€•·»«©\xa0]", r"\d", r"[.!?…,;:#|>/•·»()\[\]“”\"„€*+-]"
TOKEN = re.compile(f"{LETTER}+(?:{ODD}+{LETTER}*)*|{DIGIT}+|{MARK}")


def _bytes_of(sign: str) -> bytes:
    """A byte pattern of one sign's class, in the page that holds what the five languages write."""
    own = [bytes([b]) for b in range(256) if re.fullmatch(sign, bytes([b]).decode("cp1252", "replace"))]
    return b"[" + b"".join(map(re.escape, own)) + b"]"


#: The same tokens in encoded text, where every class is one table look-up.
TOKEN_BYTES = re.compile(b"%b+(?:%b+%b*)*|%b+|%b" % tuple(map(_bytes_of, (LETTER, ODD, LETTER, DIGIT, MARK))))


def word_class(token: str) -> str:
    """One letter for a token: function word, lower, Capital, ALL caps, miXed, number, or the mark itself."""
    c = token[0]
    if c.isalpha():
        if token.lower() in ANY_FUNCTION:
            return "f"
        rest = "".join(filter(str.isascii, token[1:]))
        if not rest or rest.islower():
            return "C" if c.isupper() else "l"
        return "A" if rest.isupper() and not c.islower() else "x"
    if c.isdigit():
        return "n"
    return {"!": ".", "?": ".", "…": ".", ";": ",", "„": "“", '"': "“", "”": "“", "·": "•", "»": ">", "[": "(", "]": "(", ")": "("}.get(c, c)


def label_language(label: str | None) -> str | None:
    """Language that a label names: one of the five, '' where the label is missing, '?' for any other language."""
    if label is None:
        return ""
    s = label.strip().lower()
    if s in MISSING_LABELS:
        return ""
    return LABEL_TO_LANG.get(re.split(r"[-_\s(]", s)[0], "?")
