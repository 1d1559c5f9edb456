"""Problem 7: broken prompt and response pairs.

Copies: the suffix automaton of the prompt's words is walked with the response, which measures how much of it the
prompt covers. Refusals: one Aho-Corasick automaton of the ways to decline, read in the opening of a response. Truncation: a stack of
delimiters for chains, sentence ends for answers. Languages: votes of stopwords, letters and alphabets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
BRACKETS = re.compile(r"[()\[\]{}]")
COMMENT = re.compile(r";[^\n]*")
# What stands in for content, as words.
STAND_INS = frozenset("n a|na|null|none|nil|nan|tbd|todo|tba|undefined|missing|empty|no answer|no chain|not available|keine|aucun|ninguno".split("|"))
# How one declines, as words (apostrophes separate words), by language.
DECLINES = {
    "en": ["i cannot", "i can t", "i can not", "i could not", "i am unable", "i m unable", "i am not able", "i m not able", "i won t", "i will not", "i must decline", "i have to decline", "i decline", "i do not feel comfortable", "i don t feel comfortable", "i d rather not", "i would rather not", "i prefer not", "i refuse", "we cannot", "we can t", "we are unable", "not something i will", "not something i can", "declines", "is declined", "no answer can be", "against the guidelines", "against my guidelines", "against policy", "not be appropriate", "unable to", "cannot help", "can t help", "not allowed to", "not able to"],
    "fr": ["je ne peux", "je ne puis", "je ne suis pas en mesure", "je ne saurais", "je dois refuser", "je dois décliner", "je refuse", "je préfère ne pas", "aucune réponse ne peut", "demande est refusée", "nous ne pouvons", "impossible de"],
    "de": ["ich kann", "kann ich", "ich darf", "darf ich", "ich möchte nicht", "möchte ich nicht", "möchte ich nichts", "ich muss ablehnen", "ich lehne", "wird abgelehnt", "gibt es keine", "wir können", "bin ich nicht", "ich bin nicht"],
    "es": ["no puedo", "no me es posible", "debo negarme", "debo rechazar", "me niego", "prefiero no", "queda rechazada", "no se puede dar", "no podemos", "no soy capaz"],
    "ru": ["я не могу", "не могу", "я отказываюсь", "вынужден отказаться", "вынуждена отказаться", "не буду", "не могу помочь", "отклонён", "отклонен", "отклоняется"],
    "it": ["non posso", "non sono in grado", "devo rifiutare", "mi rifiuto", "preferisco non", "non possiamo"],
    "pt": ["não posso", "não consigo", "não sou capaz", "devo recusar", "tenho de recusar", "recuso", "prefiro não", "não podemos"],
    "nl": ["ik kan", "kan ik", "ik mag", "mag ik", "ik weiger", "ik moet weigeren", "liever niet"],
}
# What is declined: answering, or what was asked for. In languages whose verb comes before its negation, the negation too.
ASKED = {
    "en": "answer answering respond reply help assist provide give given produce solve translate complete fulfil fulfill comply discuss share generate write create work proceed continue engage support do task request question problem step chain solution".split(),
    "fr": "répondre aider fournir donner donnée résoudre traduire produire compléter continuer discuter traiter faire question demande problème étape réponse solution".split(),
    "de": "nicht keine nichts ablehnen abgelehnt lehne antwort".split(),
    "es": "responder contestar ayudar ayudarte ofrecer dar resolver traducir producir completar continuar hacer hacerlo pregunta petición solicitud problema paso respuesta solución".split(),
    "ru": "ответить отвечать помочь решить перевести дать предоставить выполнить обсуждать продолжить сделать вопрос запрос задачу задача задание шаг ответ решение".split(),
    "it": "rispondere aiutare aiutarti fornire dare risolvere tradurre completare continuare fare domanda richiesta problema passaggio risposta".split(),
    "pt": "responder ajudar fornecer dar resolver traduzir completar continuar fazer pergunta pedido solicitação problema passo resposta".split(),
    "nl": "niet geen weiger weigeren antwoord".split(),
}
# The ways to decline that name no act themselves, and what may stand between them and the act.
UNABLE = ("cannot", "can t", "can not", "could not", "unable", "unable to", "able", "able to", "won t", "will not", "allowed to")
BETWEEN = frozenset("be able to trying try really currently just possibly directly fully".split())
# Words that make a sentence something another one said.
SAID = frozenset("said says told asked replied wrote dit disait répondit sagte sagt antwortete dijo dice respondió сказал сказала говорит disse dice zei".split())
# Frequent function words of each language.
STOPWORDS = {
    "en": "can every while still the of and is to was were by how many what which who with for each until does did will at on has had more than it takes there are all cannot left after needs because yes from then before",
    "fr": "de le la les des du et est une un dans pour combien quel quelle qui au chaque avec sur ne pas que il reste doit après cela fait tout oui non car parce jusqu plus ont puis",
    "de": "der die das und ist ein eine für wie viele welche auf dem den nach mit hat jede jeden von zu noch nicht es sind am insgesamt muss alle nein ja denn weil kann dann",
    "es": "de a no el los las del y es una un en para cuántas cuántos qué cuál que por con al cada se su quedan después hay debe puede hasta sí porque son más luego le como",
    "it": "il lo gli della delle dei degli nel nella che è sono per con una un non di quanti quante quale ogni dopo prima perché più anche questo questa ha hanno deve fino",
    "pt": "de a o os as da das do dos no na nos nas que é são para com uma um não quantos quantas qual cada depois antes porque mais também este esta tem têm deve até por ao",
    "nl": "de het een en is van voor met op niet zijn dat die hoeveel welke elke na wordt heeft hebben moet omdat meer dan ook naar bij nog alle",
    "sv": "och att det som är på för med inte av till den en ett hur många vilken varje efter har hade måste eftersom mer än också från alla",
    "pl": "i w na z nie się do jest to że co ile który która każdy po ma mają musi ponieważ więcej niż także od dla przez oraz",
    "tr": "ve bir bu için ile çok daha ne kadar kaç her sonra önce olarak olan değil gibi çünkü kadar var",
}
LETTERS = {"fr": "çœèêîôûàâ", "de": "ßäö", "es": "ñ¿¡óíú", "pt": "ãõç", "it": "òùì", "sv": "åäö", "pl": "łąęśżźć", "tr": "ğışç"}
# Alphabets that are written in few languages, as ranges of code points.
SCRIPTS = {"Cyrillic": ((0x400, 0x52F),), "Greek": ((0x370, 0x3FF),), "Hebrew": ((0x590, 0x5FF),), "Arabic": ((0x600, 0x6FF),), "Devanagari": ((0x900, 0x97F),), "Thai": ((0xE00, 0xE7F),), "Hangul": ((0xAC00, 0xD7AF),), "Han": ((0x3400, 0x9FFF), (0x3040, 0x30FF))}
# Words after which a sentence must go on: articles, prepositions, conjunctions.
DANGLING = frozenset(
    "the a an of and or to with for from by at on in because than into about until but if that which "
    "le la les des du de et ou un une pour avec sur dans au aux car parce que qui "
    "der die das den dem des und oder ein eine einen für mit von zu nach auf weil denn dass "
    "el los las del y o unos unas para con por al en porque que "
    "и или в на с к по для из от до что чтобы потому il lo gli di da e o os em no na het een van voor met".split()
)
CLOSES = {")": "(", "]": "[", "}": "{"}
COPY_WORDS = 5
COPY_COVERAGE = 0.9


class SuffixAutomaton:
    """The suffix automaton of a sequence of words."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            here = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = here
                p = self.link[p]
            if p < 0:
                self.link[here] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[here] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[here] = twin
            last = here

    def _state(self, length: int, step: dict[str, int]) -> int:
        self.next.append(step)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def matches(self, words: list[str]) -> list[int]:
        """For every word, the length of the longest run ending there that the sequence holds."""
        state = have = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                have += 1
            out.append(have)
        return out


def coverage(prompt: list[str], response: list[str], least: int = COPY_WORDS) -> tuple[float, int]:
    """(share of the response inside common runs of at least `least` words, longest run)."""
    if not response or not prompt:
        return 0.0, 0
    runs = SuffixAutomaton(prompt).matches(response)
    covered, reach = 0, len(response)
    for i in range(len(runs) - 1, -1, -1):
        if runs[i] >= least:
            start = i - runs[i] + 1
            if start < reach:
                covered += min(i + 1, reach) - start
                reach = start
    return covered / len(response), max(runs)


@lru_cache(1)
def _declining() -> ahocorasick.Automaton:
    """One automaton of all ways to decline; each tells its languages."""
    by_phrase: dict[str, set[str]] = {}
    for lang, phrases in DECLINES.items():
        for phrase in phrases:
            by_phrase.setdefault(phrase, set()).add(lang)
    a = ahocorasick.Automaton()
    for phrase, langs in by_phrase.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, langs))
    a.make_automaton()
    return a


@lru_cache(1)
def _votes() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for lang, words in STOPWORDS.items():
        for w in words.split():
            out[w] = (*out.get(w, ()), lang)
    return out


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def is_empty(text: str | None, words: list[str]) -> bool:
    return text is None or not words or len(words) <= 2 and " ".join(words) in STAND_INS


SENTENCE_END = re.compile(r"[.!?…。？！]+(?=\s|$)|\n")
OPENING_WORDS = 12


def is_refusal(text: str | None, words: list[str]) -> bool:
    """Whether a response declines: in its opening, one of its first two sentences says so within its first twelve words, and names, in the same
    sentence and language, the answering or what was asked for. Where somebody is said to say it, or it stands later, it is content."""
    if next(_declining().iter(f" {' '.join(words)} "), None) is None:
        return False
    at = 0
    for _ in range(2):
        end = SENTENCE_END.search(text, at)
        stop = end.start() if end else len(text)
        words = words_of(text[at:stop])
        if words:
            line = f" {' '.join(words)} "
            for last, (length, langs) in _declining().iter(line):
                before = line.count(" ", 0, last + 2 - length) - 1
                after = line[last:].split()
                if line[: last].endswith(UNABLE):  # then what can't be done comes next
                    after = [w for w in after if w not in BETWEEN]
                    if after and after[0] not in _asked("en"):
                        continue
                if before <= OPENING_WORDS and SAID.isdisjoint(words) and any(not _asked(lang).isdisjoint(words) for lang in langs):
                    return True
        if not end:
            return False
        at = end.end()
    return False


@lru_cache(len(ASKED))
def _asked(lang: str) -> frozenset:
    return frozenset(ASKED[lang])


def open_chain(chain: str) -> bool:
    """Whether brackets stay open at the end; comments (; to the end of the line) are skipped. A closing bracket closes
    the last open one of its kind and what was opened since."""
    if "(" not in chain and "[" not in chain and "{" not in chain:
        return False
    stack: list[str] = []
    for b in BRACKETS.findall(COMMENT.sub("", chain)):
        if b in CLOSES:
            if CLOSES[b] in stack:
                while stack.pop() != CLOSES[b]:
                    pass
        else:
            stack.append(b)
    return bool(stack)


_TAIL = " \t\r\n\v\f ​‌‍⁠﻿　    *_\"'»«”“’)]}"


def broken_sentence(answer: str, words: list[str]) -> bool:
    """Whether an answer breaks off: it has no sentence end, and stops at a comma, or after a word that must go on, or inside what is a
    sentence by its function words. Numbers with their unit, names and other noun phrases are whole without a full stop."""
    end = answer.rstrip(_TAIL)
    if not end or end[-1] in ".!?…。？！":
        return False
    named = sum(any(ch.isalpha() for ch in w) for w in answer.split())
    if end[-1] in ",;:" and named:
        return True
    if named < 3:
        return False
    if words[-1] in DANGLING:
        return True
    votes = _votes()
    by_language: dict[str, int] = {}
    for w in words:
        for lang in votes.get(w, ()):
            by_language[lang] = by_language.get(lang, 0) + 1
    by_language["ru"] = sum("Ѐ" <= w[0] <= "ӿ" for w in words) // 2
    # two function words, or one inside four words that isn't an article or preposition, as names hold those
    verbs = named >= 4 and any(w in votes and w not in DANGLING for w in words[1:-1])
    return verbs or max(by_language.values()) >= 2 and any(w in votes and w not in DANGLING or "Ѐ" <= w[0] <= "ӿ" for w in words)


def _speaks(words: list[str], text: str) -> dict[str, float]:
    """Votes for each language by function words and letters, and for each alphabet by its words."""
    score = dict.fromkeys((*STOPWORDS, *SCRIPTS), 0.0)
    votes = _votes()
    for w in words:
        langs = votes.get(w, ())
        for lang in langs:
            score[lang] += 1.0 / len(langs)
    if not text.isascii():
        low = text.lower()
        for lang, letters in LETTERS.items():
            score[lang] += 0.5 * sum(ch in low for ch in letters)
        for script, ranges in SCRIPTS.items():
            score[script] = float(sum(any(a <= ord(w[0]) <= b for a, b in ranges) for w in words))
        # words aren't set apart in Chinese and Japanese: every four signs count as one
        score["Han"] = max(score["Han"], sum(any(a <= ord(ch) <= b for a, b in SCRIPTS["Han"]) for ch in text) / 4)
    return score


def other_language(q_words: list[str], question: str, a_words: list[str], answer: str) -> bool:
    """Whether the answer's votes go to another language than the question's; too few votes decide nothing. Languages without a list
    show by what is missing: eight words and more, none of them a function word of the question's language, and few of them its own words."""
    if len(a_words) < 4 and answer.isascii():
        return False
    a, q = _speaks(a_words, answer), _speaks(q_words, question)
    mine, theirs = max(a, key=a.get), max(q, key=q.get)
    if q[theirs] < 2 or len(a_words) < 4 and mine not in SCRIPTS:
        return False
    if mine != theirs and a[mine] >= 2 and a[mine] >= 1.5 * a[theirs] + 0.5 and q[theirs] >= 1.5 * q[mine] + 0.5:
        return True
    spelled = [w for w in a_words if w.isalpha()]
    return len(spelled) >= 8 and q[theirs] >= 4 and a[theirs] == 0 and 4 * len(set(spelled) & set(q_words)) <= len(spelled)


def defect_of(question: str | None, chain: str | None, answer: str | None) -> str | None:
    """The defect of one pair, or None. Looked for in this order: empty, refusal, copy, truncated, language."""
    q_words = words_of(question) if question else []
    c_words = words_of(chain) if chain else []
    a_words = words_of(answer) if answer else []
    if is_empty(chain, c_words) or is_empty(answer, a_words):
        return "empty"
    if is_refusal(answer, a_words) or is_refusal(chain, c_words):
        return "refusal"
    if q_words:
        known = set(q_words)
        for words in (a_words, c_words):
            if len(words) >= COPY_WORDS and sum(w in known for w in words) >= COPY_COVERAGE * len(words):
                share, longest = coverage(q_words, words)
                if share >= COPY_COVERAGE and longest >= COPY_WORDS:
                    return "copy"
    if open_chain(chain) or broken_sentence(answer, a_words):
        return "truncated"
    if question and other_language(q_words, question, a_words, answer):
        return "language"
    return None


def defective_pairs(df: DataFrame, pair_id: str, question: str, chain: str, answer: str) -> DataFrame:
    """(pair_id, defect) of the defective pairs, one row for each distinct row of the input.

    Null or blank chains and answers are 'empty'; a null question can't be copied or differ in language. Rows with a
    null id are left out. Texts are read whole; the work is in proportion to their length. Nothing is shuffled but the result.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [defect_of(q, c, a) for q, c, a in zip(pdf["q"], pdf["c"], pdf["a"], strict=True)]
            out = pd.DataFrame({"id": pdf["id"], "defect": pd.Series(found, dtype=object)})
            yield out[out["defect"].notna()]

    text = lambda c: F.col(c).cast("string")
    plain = df.select(F.col(pair_id).cast("bigint").alias("id"), text(question).alias("q"), text(chain).alias("c"), text(answer).alias("a")).where("id is not null")
    return plain.mapInPandas(judge, "id bigint, defect string").distinct().select(F.col("id").alias(pair_id), "defect")
