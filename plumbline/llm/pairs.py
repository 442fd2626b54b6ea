"""Broken prompt and response pairs (problem 3).

Ordered rules: no content, cut off, refusal, copy of the question, another
language. Every rule that fires is emitted with its rank; the first one names the
defect. The rule for cut-off answers is the operator of truncation, so both agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pagespam import FUNCTION_WORDS
from .text import copies_question, fold
from .truncation import find_truncated

#: Order of the rules.
RULES = ("empty", "truncated", "refusal", "copies_question", "other_language")
#: Stand-ins for a missing text. "None", "No" and "0" are answers.
STAND_INS = frozenset(
    ["n/a", "na", "nan", "null", "nil", "undefined", "missing", "empty", "no answer", "no response", "no text", "not available", "no output", "blank", "tbd"]
)
_EDGE = " \t\r\n\v\f​‌‍﻿⁠ "

_EN = re.compile(
    r"\b(?:can ?not|can't|could not|couldn't|unable|not able|won't be able|won't|will not|must|have to|has to|need to|rather not|not possible|neither confirm|not going to|do not|don't|not in a position)\b"
    r"[^.!?]{0,70}\b(?:answer|help|assist|discuss|respond|reply|comment|decline|refuse|pass on|pass|share|speak|provide|confirm)\b"
    r"|\b(?:decline to|refuse to|must decline|have to decline|outside what i|against my (?:guidelines|policy|rules)|stay away from|not permit|talk about something else"
    r"|not be appropriate|feel comfortable|without my answer|people who are allowed|no answer can be given|is not possible for me|not something i|am not allowed|restricted topic|not supposed to)\b",
)
_OTHER = re.compile(
    r"keine auskunft|(?:nicht|leider nicht) (?:beantworten|antworten|helfen|weiterhelfen)|kann ich (?:leider )?nicht|dazu kann ich|fachperson"
    r"|ne (?:peux|puis|saurais) pas|impossible de vous|pas en mesure|je refuse|specialiste|prefere ne pas"
    r"|no puedo|no me es posible|lo siento|no estoy en condiciones|debo negarme|prefiero no"
    r"|non posso|non sono in grado|mi dispiace|devo rifiutare|preferisco non"
    r"|nao posso|nao consigo|desculpe|nao me e possivel|prefiro nao|sinto muito"
    r"|niet beantwoorden|geen antwoord (?:op )?geven|niet (?:mee |bij |verder )?helpen|helaas kan ik|kan ik (?:helaas |u |je )*(?:niet|geen)|het spijt me|weiger ik|ik weiger|moet ik weigeren"
    r"|nie moge (?:\w+ )?(?:odpowiedziec|pomoc|udzielic)|nie jestem w stanie|nie potrafie (?:odpowiedziec|pomoc)|przykro mi|niestety nie (?:moge|jestem)|odmawiam|musze odmowic|przepraszam"
    r"|cevap veremem|cevaplayamam|yan[ıi]tlayamam|yard[ıi]mc[ıi] olamam|yard[ıi]m edemem|uzgunum|maalesef|reddediyorum|mumkun degil"
)
_OTHER_SCRIPTS = re.compile(fold(
    r"не могу|не смогу|извините|к сожалению|вынужден|не имею возможности|отказаться"
    r"|できません|お答えでき|お手伝いでき|申し訳|控えさせ|お断り"
    r"|(?:无法|不能|不便|无权|無法|不便)(?:\w{0,4})(?:回答|提供|协助|帮助|讨论|評論|协助|幫助|透露)|拒绝(?:\w{0,3})回答|(?:很|非常)?抱歉|恕(?:我)?(?:无法|不能|難)|对不起"
    r"|لا أستطيع|لا يمكنني|لا استطيع|أعتذر|عذرا|آسف|غير قادر|لست قادر|أرفض"
    r"|(?:답변|답|대답|도와|도움|알려|제공|말씀)(?:\w| ){0,6}(?:수 없|어렵)|죄송|거절|거부합니다"
    r"|नहीं दे सकत|नहीं कर सकत|जवाब नहीं|उत्तर नहीं|क्षमा करें|क्षमा चाहत|माफ करें|असमर्थ|खेद है"
))
_COURTESY = re.compile(
    r"\b(?:thank you|thanks|i hope|anything else|happy to|perhaps|you may want|please|interesting topic|i understand|hmm|sorry|apologies|unfortunately|regrettably|as a language model|as an ai|consult|contact|you can|good luck|feel free|let me know|bitte|gern|veuillez|merci|por favor|consulte|gracias|per favore|grazie|obrigad[oa]"
    r"|alstublieft|raadpleeg|bedankt|prosze|skonsultuj|dziekuje|lutfen|tesekkur|danis[ıi]n)\b"
)
_COURTESY_SCRIPTS = re.compile(fold(
    r"\b(?:пожалуйста|обратитесь|спасибо)\b|ください|ありがとう|専門家|请|請|谢谢|謝謝|专业人士|يرجى|شكرا|مختص|부탁|문의하|감사|전문가|कृपया|धन्यवाद|विशेषज्ञ"
))
_SENTENCES = re.compile(r"(?<=[.!?;。！？؟।])\s*")
_NAMES = {
    "en": "english|englisch|anglais|ingles|inglese|английск\\w*|英語",
    "de": "german|deutsch|allemand|aleman|tedesco|alemao|немецк\\w*|ドイツ語",
    "fr": "french|franzosisch|francais|frances|francese|французск\\w*|フランス語",
    "es": "spanish|spanisch|espagnol|espanol|spagnolo|espanhol|испанск\\w*|スペイン語",
    "it": "italian|italienisch|italien|italiano|итальянск\\w*|イタリア語",
    "pt": "portuguese|portugiesisch|portugais|portugues|portoghese|португальск\\w*|ポルトガル語",
    "ru": "russian|russisch|russe|ruso|russo|русск\\w*|ロシア語",
    "ja": "japanese|japanisch|japonais|japones|giapponese|японск\\w*|日本語",
    "zh": "chinese|chinesisch|chinois|chino|cinese|chines|китайск\\w*|中国語",
    "ar": "arabic|arabisch|arabe|arabo|арабск\\w*|アラビア語",
    "ko": "korean|koreanisch|coreen|coreano|корейск\\w*|韓国語",
}
_ASKS = {k: re.compile(rf"\b(?:in|auf|en|em|на|по|answer|reply|respond|antworte\w*)?\s*(?:{v})\b|(?:{v})で", re.I) for k, v in _NAMES.items()}
#: Question words, which tell the language of a short question.
_QUESTION_WORDS = {
    "en": "who what which where when how why whose many much", "fr": "où combien quel quelle quels quelles quand comment pourquoi quoi vient d l",
    "de": "wer was wo woher wohin wann wieso warum welche welcher welches wessen viele wieviel wem wen", "es": "cuántos cuántas cuánto cuál cuáles qué quién quiénes dónde cuándo cómo en",
    "it": "quanti quante quanto quale quali chi dove quando come perché cosa", "pt": "quantos quantas quanto qual quais quem onde quando como porquê", "ru": "кто что где когда как почему сколько какой какая какое какие откуда чей",
}
_FOLDED = {k: frozenset(f"{v} {_QUESTION_WORDS[k]}".split()) for k, v in FUNCTION_WORDS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = (
    ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("zh", re.compile(r"[一-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")),
    ("he", re.compile(r"[֐-׿]")), ("hi", re.compile(r"[ऀ-ॿ]")),
)


def is_empty(t: str | None) -> bool:
    """No content, or only a stand-in for it."""
    if t is None:
        return True
    s = t.strip(_EDGE)
    bare = s.strip("[](){}<>\"'`“”’‘*_#.  ").casefold()
    if not bare:
        return not any(c.isalnum() for c in s)
    if not any(c.isalnum() for c in bare):
        return True
    return bare in STAND_INS


def is_refusal(t: str) -> bool:
    """Declines, and no sentence of it gives an answer."""
    s = fold(t.replace("’", "'").replace("‘", "'"))
    declined, foreign = False, not s.isascii()
    for part in _SENTENCES.split(s):
        if not part.strip(" .!?;\n"):
            continue
        if _EN.search(part) or _OTHER.search(part) or foreign and _OTHER_SCRIPTS.search(part):
            if re.search(r"\b(?:but|however|still)\b[^.]*\b(?:is|was|are|were|gives?|says|lists?|has)\b", part) and not re.search(r"\bbut i (?:can|must|have|am|will|would|do)\b", part):
                return False
            declined = True
        elif not (_COURTESY.search(part) or foreign and _COURTESY_SCRIPTS.search(part)):
            return False
        elif re.search(r"\d{2,}", part) or re.search(r"\b(?:the|an) (?:entry|answer|record|value)\b[^.]*\b(?:is|gives|has|says)\b", part):
            return False
    return declined


def language_of(t: str) -> str | None:
    """Language of most of the text, or None if too little tells."""
    words = _LETTERS.findall(t.lower())
    usual = sum(w in _FOLDED["en"] for w in words)
    if usual >= 3 and 4 * usual >= len(words):
        return "en"
    if not t.isascii():
        letters = sum(map(len, words))
        for k, rx in _SCRIPTS:
            if 0 < letters <= 3 * len(rx.findall(t)):
                return k
        if len(_SCRIPTS[0][1].findall(t)) >= 6:
            return "ja"
    hits = {k: sum(w in v for w in words) for k, v in _FOLDED.items()}
    ranked = sorted(hits.items(), key=lambda x: -x[1])
    if ranked[0][1] < 2 or ranked[0][1] == ranked[1][1]:
        return None
    return ranked[0][0]


def other_language(question: str | None, answer: str) -> bool:
    """Is the answer mostly in another language than the question, which doesn't ask for it?"""
    if not question or not question.strip():
        return False
    a = language_of(answer)
    if a is None:
        return False
    q = language_of(question)
    if q is None or a == q:
        return False
    if a in _ASKS and _ASKS[a].search(fold(question)):
        return False
    if a in _FOLDED and q in _FOLDED:
        words = re.findall(r"[^\W\d_]+", answer.lower())
        na, nq = sum(w in _FOLDED[a] for w in words), sum(w in _FOLDED[q] for w in words)
        return na >= 3 and na >= 1.5 * nq
    return True


def defects_of(question: str | None, original: str | None, answer: str | None) -> list[str]:
    """Rules other than truncation that fire, in order."""
    if is_empty(answer):
        return ["empty"]
    out = []
    if is_refusal(answer):
        out.append("refusal")
    if copies_question(answer, [question, original]):
        out.append("copies_question")
    if other_language(question, answer):
        out.append("other_language")
    return out


def pair_defects(
    df: DataFrame, key: str = "attack_id", question: str = "perturbed_question", original: str = "original_question", answer: str = "answer"
) -> DataFrame:
    """``key, defect, rank`` of every rule that fires on a pair.

    A null answer is empty; a null question is no defect and tells no language;
    repeated rows give one row per rule; other columns are not read, but for
    ``source`` in the truncation rule.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, q, o, a = (c.to_pylist() for c in b.columns)
            rows = [(k, d) for k, x, y, z in zip(keys, q, o, a) for d in defects_of(x, y, z)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string())], names=[key, "defect"]
            )

    rules = df.select(key, question, original, answer).mapInArrow(run, f"`{key}` {kind}, defect string")
    cut = find_truncated(df, (answer,), key, asked=(question, original)).select(key, F.lit("truncated").alias("defect"))
    rank = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("defect"))
    return rules.unionByName(cut).groupBy(key, "defect").agg(F.lit(1).alias("_")).select(key, "defect", rank.cast("int").alias("rank"))


def broken_pairs(df: DataFrame, key: str = "attack_id", **cols: str) -> DataFrame:
    """``key, defect``: one row for each defective pair, with the first rule that fires."""
    return pair_defects(df, key, **cols).groupBy(key).agg(F.min_by("defect", "rank").alias("defect"))


def defect_rates(df: DataFrame, key: str = "attack_id") -> DataFrame:
    """``judge_label, defect, n``: defects against the judge's label."""
    labels = df.groupBy(key).agg(F.min("judge_label").alias("judge_label"))
    return broken_pairs(df, key).join(labels, key).groupBy("judge_label", "defect").agg(F.count("*").alias("n"))
