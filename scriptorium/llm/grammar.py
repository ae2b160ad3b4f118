"""The pattern grammar of the toxicity operator: weighted finite-state transducers over the words of a sentence.

Two passes, as in a bimachine. From right to left, the transducer AHEAD marks each symbol with what still comes: a target in
the clause, a direct object, and a verb of speech behind a comma, colon or quotation mark. From left to right, the
transducer BEHIND reads the marked symbols and gives each its factor; it is composed of one for negation, one for reported speech, one
for the targets of insults, one for objects before their verb, and one for the passive. Compositions are made as they are
needed: of their pairs of states only those that texts lead to.

A clause ends at a comma, colon, quotation mark or conjunction, a sentence's end ends all. An insult is bound by a target
in its clause, or as an address that is a clause by itself; one that isn't bound is loose. A threat counts against its
object: a person directly behind it or, where pronouns come first, before it, or the subject of a passive. What a preposition
links or a possessive owns is no object. After an insertion between commas, a clause that goes on with a form of "to be", a modal verb
or an article has the target from before."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

# Fixed word lists (English, German, French, Spanish). Verbs of threat with their forms: beginning, endings.
_THREATS = (
    ("kill", "- s ing"), ("murder", "- s ing"), ("strangl", "e es ing"), ("stab", "- s bing"), ("hurt", "- s ing"), ("destroy", "- s ing"), ("shoot", "- s ing"), ("slaughter", "- s ing"),
    ("töte", "- n t st te ten"), ("umbring", "en e t st"), ("umzubringen", "-"), ("erschlag", "en e"), ("erschläg", "t st"), ("vernicht", "en e et est"), ("erwürg", "en e t st"), ("erschieß", "en e t"),
    ("tue", "- r s rai ra rons"), ("égorge", "- r s rai ra"), ("étrangle", "- r s rai ra"), ("détrui", "re rai ra s t"),
    ("mata", "r ré rá remos ron rte rlo rla"), ("maté", "-"), ("destrui", "r ré rá remos rte"), ("golpea", "r ré rá rte"), ("estrangula", "r ré rá rte"), ("apuñala", "r ré rá rte"),
)
#: Those with their object in them.
CLITIC = frozenset("matarte destruirte golpearte estrangularte apuñalarte".split())
THREAT = frozenset(begin + ("" if e == "-" else e) for begin, ends in _THREATS for e in ends.split()) - CLITIC
#: Participles and past forms: threats, and those of a passive.
STRUCK = frozenset("killed murdered strangled stabbed destroyed shot slaughtered getötet umgebracht erschossen tué tuée tués tuées égorgé égorgée étranglé étranglée matado destruido golpeado estrangulado apuñalado".split())
YOU = frozenset("you ye du ihr tu vous tú usted ustedes vosotros".split())
YOU_OBJECT = frozenset("yourself dich dir euch te toi ti os".split())
YOUR = frozenset("your yours dein deine deinen deiner euer eure ta ton tes votre vos tus tuyo tuya".split())
PERSON = frozenset("he she they this these er il ils elle elles él ella ellos ellas este esta his their".split())
PERSON_OBJECT = frozenset("him her them ihn ihm sie ihnen lui leur".split())
NEGATION = frozenset("not never no neither nor nobody nicht kein keine keinen keiner nie niemals pas jamais ni non nunca jamás tampoco cannot".split())
REPORTED = frozenset("said says say saying quoted quotes claimed claims reported reports alleged wrote writes sagte sagt sagen behauptete behauptet schrieb schreibt dit disait affirmait affirme écrit écrivait dijo dice decía afirmó afirma escribió".split())
BE = frozenset("be been being get gets got are is was were bist seid ist sind wirst werdet wird werden worden wurde sera seras serez seront es êtes est sont fut serás será eres son sois seréis".split())
MODAL = frozenset("will would shall should must can could may might ought sollst soll musst muss dois doit debes debe".split())
ARTICLE = frozenset("a an ein eine einen un une una".split())
FILLER = frozenset("all both every each one of at to à auf an alle todos tous even also dann schon bien".split())
PREPOSITION = frozenset("for with by from about near around without für mit bei ohne von pour avec par sans chez por para con sin".split())
CONJUNCTION = frozenset("and or but because that which who if when while so than und oder aber weil dass denn wenn et ou mais que qui parce y o pero porque si cuando".split())

_LEXICON = (
    ("clitic", CLITIC), ("threat", THREAT), ("struck", STRUCK), ("negation", NEGATION), ("you", YOU), ("object", YOU_OBJECT), ("your", YOUR), ("person", PERSON), ("them", PERSON_OBJECT), ("reported", REPORTED),
    ("be", BE), ("modal", MODAL), ("article", ARTICLE), ("filler", FILLER), ("preposition", PREPOSITION), ("conjunction", CONJUNCTION),
)
_SYMBOL = {w: name for name, words in reversed(_LEXICON) for w in words}
SYMBOLS = ("insult", *(name for name, _ in _LEXICON), "mark", "other")
#: All that may be a threat.
THREATS = CLITIC | THREAT | STRUCK
HOSTILE = ("insult", "threat", "struck", "clitic")
#: Words that a negation reaches over; words before and after a target that it reaches; words between a mark and the verb
#: of speech behind it; words from an object to the verb behind it, and from "to be" to the participle; words of an insertion.
NEGATED, BEFORE, AFTER, SPOKEN, TO_VERB, TO_PARTICIPLE, INSERTED = 3, 6, 4, 3, 4, 3, 4
#: Factors of what is negated, of what is reported, of an insult with a target, of a threat against others.
NEGATED_FACTOR, REPORTED_FACTOR, BOUND, OTHERS = 0.2, 0.4, 1.25, 0.5

SENTENCE = re.compile(r"[.!?;\n]+")
#: A contracted negation ("n't", the elided "n'"), a word, or a mark.
TOKEN = re.compile(r"[^\W\d_]+?n['’]t(?![^\W\d_])|n['’](?=[^\W\d_])|[^\W\d_]+|[,:\"«»“”„]")

#: Who a target is: 2 the reader, 1 others.
_WHO = {"you": 2, "object": 2, "your": 2, "person": 1, "them": 1}
_OBJECTS = {"you": 2, "object": 2, "them": 1}


def lexical(token: str) -> str:
    """The symbol of a token that is no insult."""
    if not token[0].isalpha():
        return "mark"
    if token[-1] in "'’" or token[-2:-1] in ("'", "’"):
        return "negation"
    return _SYMBOL.get(token, "other")


class Transducer:
    """A deterministic weighted transducer: step(state, symbol) gives the next state and the output. Arcs are kept once they are made."""

    def __init__(self, start: object, step: Callable) -> None:
        self.start, self.made, self.arcs = start, step, {}

    def step(self, state, symbol):
        if (found := self.arcs.get((state, symbol))) is None:
            found = self.arcs[state, symbol] = self.made(state, symbol)
        return found

    def compose(self, other: Transducer, together) -> Transducer:
        """Both at once: pairs of states, outputs put together."""

        def step(state, symbol):
            (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (a, b), together(x, y)

        return Transducer((self.start, other.start), step)

    def run(self, symbols: Sequence) -> list:
        state, out = self.start, []
        for s in symbols:
            state, x = self.step(state, s)
            out.append(x)
        return out


def _near(words: int) -> Transducer:
    """Read in either direction: the target within so many words in the clause, the reader before others. State: who, words left."""

    def step(state, s):
        who, left = state
        if s in ("mark", "conjunction"):
            return (0, 0), who
        found = _WHO.get(s, 0)
        after = (found, words) if found and found >= who else (who, left - 1) if left > 1 else (0, 0)
        return after, who

    return Transducer((0, 0), step)


def _object() -> Transducer:
    """Read from the right: the person directly behind, fillers apart."""
    return Transducer(0, lambda state, s: (_OBJECTS.get(s, state if s in ("filler", "article") else 0), state))


def _spoken() -> Transducer:
    """Read from the right: whether a verb of speech stands behind a mark that comes later. Persists to the sentence's start."""

    def step(state, s):
        if state == "reported":
            after = state
        elif s == "reported":
            after = SPOKEN
        elif isinstance(state, int):
            after = "reported" if s == "mark" else state - 1 or "none"
        else:
            after = "none"
        return after, state == "reported"

    return Transducer("none", step)


def _edge() -> Transducer:
    """Read in either direction: whether only insults stand between here and the clause's edge."""
    return Transducer(True, lambda state, s: (s in ("mark", "conjunction") or state and s == "insult", state))


AHEAD = _near(AFTER).compose(_object(), lambda x, y: (x, y)).compose(_spoken(), lambda x, y: (*x, y)).compose(_edge(), lambda x, y: (*x, y))


def _negation() -> Transducer:
    """Weights within the scope of a negation shrink."""

    def step(left, marked):
        s = marked[0]
        after = NEGATED if s == "negation" else 0 if s == "mark" else max(left - 1, 0)
        return after, NEGATED_FACTOR if left and s in HOSTILE else 1.0

    return Transducer(0, step)


def _reported() -> Transducer:
    """Weights after a verb of speech, to the sentence's end, shrink, and so do those that one behind a mark reports."""

    def step(on, marked):
        s, later = marked[0], marked[3]
        return on or s == "reported", REPORTED_FACTOR if (on or later) and s in HOSTILE else 1.0

    return Transducer(False, step)


def _resumed() -> Transducer:
    """The target from before an insertion or an apposition. Its output goes to the transducers of targets: who it is, at the word that goes on."""

    def step(state, marked):
        s, (kind, who, left) = marked[0], state
        found = _WHO.get(s, 0)
        if s == "mark":
            after = ("apart", who, INSERTED) if kind == "clause" else ("closed", who, 0)
            return after if who else ("clause", 0, 0), 0
        if kind == "clause":
            return (("clause", 0, 0) if s == "conjunction" else ("clause", max(who, found), 0)), 0
        if s in ("be", "modal") or s == "article" and (kind == "closed" or left == INSERTED):
            return ("clause", who, 0), who
        # words of the insertion; a clause of its own has its own target
        return (("apart", who, left - 1) if kind == "apart" and left else ("clause", found, 0)), 0

    return Transducer(("clause", 0, 0), step)


def _bound() -> Transducer:
    """1 with the address or target of an insult, 0 if it is loose, None for other symbols."""
    near, edge, resumed = _near(BEFORE), _edge(), _resumed()

    def step(state, marked):
        (a, b, c), (s, ahead, _, _, open_) = state, marked
        b, clear = edge.step(b, s)
        c, again = resumed.step(c, marked)
        a, behind = near.step(a, s)
        if again:
            a = (again, BEFORE)
        return (a, b, c), None if s != "insult" else BOUND if max(behind, ahead) else 1.0 if clear and open_ else 0.0

    return Transducer((near.start, edge.start, resumed.start), step)


def _against() -> Transducer:
    """The factor of a threat: by its object, behind or before it, or by the subject of its passive."""
    resumed = _resumed()

    def step(state, marked):
        (object_, before), (subject, passive, left), again_state = state
        s, _, behind = marked[:3]
        again_state, again = resumed.step(again_state, marked)
        who = max(behind, object_ if before else 0, passive if s == "struck" and left else 0, 2 if s == "clitic" else 0) if s in ("threat", "struck", "clitic") else None
        if s in ("mark", "conjunction"):
            after = (0, 0), (0, 0, 0)
        else:
            first = {"object": 2, "them": 1}.get(s, 0)  # forms that are never a subject
            object_, before = (first, TO_VERB) if first else (object_, before - 1) if before > 1 and s != "preposition" else (0, 0)
            subject = max(subject, again, {"you": 2, "person": 1}.get(s, 0))
            passive, left = (subject, TO_PARTICIPLE) if s == "be" and subject else (passive, left - 1) if left > 1 else (0, 0)
            after = (object_, before), (subject, passive, left)
        return (*after, again_state), None if who is None else (0.0, OTHERS, 1.0)[who]

    return Transducer(((0, 0), (0, 0, 0), resumed.start), step)


def _judged(scope: float, of: tuple) -> tuple[float, bool]:
    bound, against = of
    if bound is not None:
        return scope * (bound or 1.0), not bound
    return scope * (1.0 if against is None else against), False


BEHIND = _negation().compose(_reported(), lambda f, g: f * g).compose(_bound().compose(_against(), lambda x, y: (x, y)), _judged)


def factors(symbols: Sequence[str]) -> list[tuple[float, bool]]:
    """The factor of each symbol of a sentence, and whether it is a loose insult."""
    ahead = AHEAD.run(symbols[::-1])[::-1]
    return BEHIND.run([(s, *x) for s, x in zip(symbols, ahead, strict=True)])
