"""Terms and phrases that abuse detection looks for. They are data: rows (tier, kind, text) of a table, of which the seeds here
are a first version. The driver compiles them into one pattern per tier.

A row of kind ``word`` is a term, whose inner spaces may be missing. A row of kind ``phrase`` is a sequence of items: a word,
alternatives ``a|b`` (with ``_`` inside those of several words), a group ``<name>``; ``?`` behind an item makes it optional,
and ``..`` stands for up to two words. A row
of kind ``pattern`` is a regular expression over normalized text, where quotation marks and apostrophes are spaces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Groups that phrases name; an entry may have several words.
GROUPS: dict[str, str] = {
    "will": "i will|i ll|ill|im gonna|i m gonna|i am gonna|im going to|i m going to|i am going to|gonna|we will|we ll|we are going to",
    "harm": "kill|hurt|stab|shoot|beat|strangle|burn|murder|choke|cripple|harm",
    "person": "you|u|him|her|them|yall|you all",
    "your": "your|ur|his|her|their",
    "kin": "mother|mom|mum|father|dad|sister|brother|wife|husband|son|daughter|kids|children|family|parents",
    "place": "house|home|flat|apartment|school|office|workplace|street|door|dorm",
    "weapon": "gun|knife|rifle|pistol|machete|bat|hammer|shotgun",
    "private": "address|phone|number|ip|real name|workplace|location|photos|passwords|details|school",
    "people": "muslims|jews|christians|hindus|immigrants|migrants|refugees|foreigners|gays|lesbians|trans people|blacks|whites|asians|arabs|women|men|disabled people",
    "beast": "animals|vermin|cockroaches|parasites|rats|a disease|a plague|filth|subhuman|not human",
    "self": "yourself|urself|yourselves",
}

_MILD = (
    "airhead arse ass asshole bastard bitch blockhead bonehead clown coward crap creep damn dimwit disgusting dumb dumbass dunce failure fool freak fuck fucking garbage halfwit idiot imbecile jackass jerk "
    "liar loser lowlife maggot moron muppet nitwit numbskull pathetic prick scum shit simpleton stupid swine trash twit ugly useless weasel wimp worthless wretch"
).split()

#: Each family by what it should catch.
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "telling someone to harm themselves": ("severe", ("kill|hang|shoot|drown|hurt <self>", "end your own? life", "jump off a|the bridge|roof|building", "drink some? bleach", "do us|everyone a favor|favour and die|disappear", "kys")),
    "wishing someone dead": ("severe", ("i hope|wish you|u .. die|rot|suffer|choke", "i hope you get cancer|run_over|shot", "you|u should|ought_to|need_to|deserve_to|must .. die", "you|u deserve death", "rot in hell", "nobody wants you alive", "we_are|everyone_is happier when|once you|u are dead|gone")),
    "denying that people are human": ("severe", ("you|u people? are|r <beast>", "<people> are|r .. <beast>", "you|u belong in a cage|zoo|sewer")),
    "hate by identity": ("severe", ("all? <people> should|must|need_to|deserve_to .. die|burn|hang|disappear", "all? <people> should|must be deported|exterminated|gassed|shot|banned", "go back to your|ur own? country|jungle|village", "death to all? <people>")),
    "sexual harassment": ("severe", ("send me? .. nudes|nude_pics|naked_pics|naked_photos", "show me your|ur body|boobs|breasts|ass", "i want|wanna to? touch|undress|fuck|grope you|u", "you|u look rapeable", "<will> rape you|u|her")),
    "saying that one will hurt someone": ("threat", ("<will> .. <harm> <person>", "<will> .. <harm> <your> <kin>", "<will> break your|ur legs|neck|face|bones|jaw", "<will> .. find you|u|them|him|her", "<will> make you|u bleed|disappear|suffer")),
    "weapons": ("threat", ("i have|got|bought|own a|my <weapon> for|with .. you|u|your_name|ur_name", "bullet for|in|through your|ur head|skull|face", "<will> bring a|my <weapon> .. your? <place>")),
    "knowing where someone is": ("threat", ("i|we know|found|learned out? where your|ur <kin> live|lives|work|works|sleep|study", "i|we know|found|learned out? where you|u|he|she|they live|work|sleep|study", "i|we found your|ur <place>", "i_m|i_am|we_are outside|near your|ur <place>", "on_my_way|coming to your|ur <place>")),
    "laying private data open": ("threat", ("<will> post|leak|publish|share|drop|dump <your> home? <private>", "<will> dox|doxx <person>", "everyone will see|get your|ur home? <private>")),
    "sending police to someone's door": ("threat", ("<will> swat <person>", "<will> call|send .. police|cops|swat .. your|ur <place>", "swat team? coming|going to? your|ur <place>", "get|getting you|u swatted")),
    "threats to a family": ("threat", ("your|ur <kin> is|are|will be? next|dead|not_safe|in_danger", "your|ur <kin> will|gonna pay|die|suffer|bleed", "think of|about your|ur <kin> before")),
    "warnings": ("threat", ("your|ur days are numbered|counted", "you|u are|re|r a? dead_man|dead_meat|dead", "you|u won_t|will_not|wont live|survive|make_it to|past|until|through .. tomorrow|tonight|morning|week", "sleep with one eye open", "watch|look over? your|ur shoulder|back tonight|tomorrow|outside")),
}

SEED: tuple[tuple[str, str, str], ...] = (*(("mild", "word", w) for w in _MILD), *((tier, "phrase", p) for tier, phrases in FAMILIES.values() for p in phrases))

_HARMED = f"(?:{GROUPS['harm']}|destroy|wreck|crush|smash|end|finish|own)"
_SELF_INSULT = "(?:stupid|dumb|idiot|moron|fool|failure|loser|useless|worthless|pathetic|trash|garbage|ugly)"
#: Contexts that take a finding back, or send it to a person.
MITIGATIONS: tuple[tuple[str, str], ...] = (
    # somebody else's words: a third person speaks, or words were spoken to one who is not addressed here
    ("reported-speech", r"(?:he|she|they|who|people|folks|someone|somebody|guy|girl|kid)\s+(?:just\s+|once\s+|also\s+|even\s+)?(?:said|says|told|called|yelled|screamed|shouted|typed|wrote|texted|messaged)|(?:told|called|texted|messaged|wrote\s+to|yelled\s+at|screamed\s+at|shouted\s+at)\s+(?:me|us|my)"),
    # only these survive normalizing
    ("quotation", "“[^”]{2,400}”|‘[^’]{2,400}’|«[^»]{2,400}»"),
    ("negated-intent", rf"(?:never|not|cannot|nobody|refuse|(?:don|won|wouldn|can|couldn|didn|doesn)\s*t)\s+(?:\w+\s+){{0,4}}{_HARMED}"),
    ("reporting-abuse", r"(?:report(?:ed|ing|s)?|flag(?:ged|ging)?|moderators?|mods?|admins?|support)\s+(?:\w+\s+){0,8}(?:said|says|wrote|called|threat\w*|abus\w*|harass\w*|insult\w*|bull(?:y|ied|ying)|spam\w*)"),
    ("self-directed", rf"i\s+(?:am|m|feel|felt|was|look)\s+(?:\w+\s+){{0,3}}{_SELF_INSULT}|(?:hate|blame|despise)\s+myself|(?:stupid|dumb)\s+me"),
    ("gaming-context", rf"{_HARMED}\s+(?:\w+\s+){{0,6}}(?:round|match|game|games|lobby|map|ranked|tournament|raid|boss|level|quest|duel|chess|checkers|arena|finals?)"),
)
SELF_HARM = (
    r"i\s+(?:just\s+|really\s+)?(?:want|wanna|wish|plan|intend|need)\s+(?:to\s+|i\s+could\s+)?(?:die|be\s+dead|disappear\s+forever|end\s+my\s+life|end\s+it\s+all|kill\s+myself|hurt\s+myself)"
    r"|(?:thinking|thoughts?|thought)\s+(?:about|of)\s+(?:suicide|killing\s+myself|ending\s+it)|no\s+reason\s+(?:left\s+)?(?:to|for)\s+(?:live|living|go\s+on)|can\s*t\s+go\s+on\s+(?:living|like\s+this)"
)
_HANDLE = r"(?:^|\s)@[a-z0-9_.-]{2,}"
_EDGE_L, _EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
TARGET_WORDS, OTHER_WORDS = "you|u|ur|your|yours|yourself|yall", "you|u|your|him|his|her|them|they"
TARGET = rf"{_HANDLE}|{_EDGE_L}(?:{TARGET_WORDS}){_EDGE_R}"
OTHER_TARGET = rf"{_EDGE_L}(?:{OTHER_WORDS}|@\w+){_EDGE_R}"
#: Words of which each match of SELF_HARM has one.
SELF_HARM_WORDS = "die|dead|forever|life|all|myself|thinking|thoughts|thought|reason|living|like"


def bounded(pattern: str) -> str:
    """Word boundaries as the web has them: only ASCII letters, digits and _ are word characters."""
    return rf"{_EDGE_L}(?:{pattern}){_EDGE_R}"


def _item(text: str, gap: str) -> str:
    """One of some alternatives, groups filled in; each may have several words."""
    options = GROUPS[text[1:-1]].split("|") if text.startswith("<") else text.split("|")
    return "(?:" + "|".join(gap.join(map(re.escape, o.replace("_", " ").split())) for o in options) + ")"


def phrase_pattern(phrase: str, dense: bool = False) -> str:
    """The regular expression of a phrase; a dense one is for text whose spaces are gone."""
    gap, some = (r"\s*", r"\w{0,12}") if dense else (r"\s+", r"(?:\w+\s+){0,2}")
    out, open_ = "", False  # open_: an item stands before that still lacks its space
    for text in phrase.split():
        if text == "..":
            out, open_ = out + (gap if open_ else "") + some, False
        elif text.endswith("?"):
            own = _item(text[:-1], gap)
            out, open_ = (f"{out}(?:{gap}{own})?", True) if open_ else (f"{out}(?:{own}{gap})?", False)
        else:
            out, open_ = out + (gap if open_ else "") + _item(text, gap), True
    return out


def _words_of(kind: str, text: str) -> frozenset[str] | None:
    """Words of which each match of an entry in text with its spaces has one, between word boundaries; None if that can't be said.
    Of a phrase's items that must be there, that of the longest words is taken, as it is rarest."""
    if kind == "word":
        found = [{text}]
    elif kind == "phrase":
        must = [x for x in text.split() if x != ".." and not x.endswith("?")]
        options = [GROUPS[x[1:-1]].split("|") if x.startswith("<") else x.split("|") for x in must]
        found = [{max(o.replace("_", " ").split(), key=len) for o in some} for some in options]
    else:
        found = []
    found = [x for x in found if all(re.fullmatch("[a-z0-9]+", w) for w in x)]
    return frozenset(max(found, key=lambda x: (min(map(len, x)), sum(map(len, x)) / len(x)))) if found else None


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[tuple[str, str, str], ...] = SEED
    allow: tuple[str, ...] = ()
    version: str = "1"
    patterns: dict[str, str] = field(init=False)
    dense: dict[str, str] = field(init=False)
    #: Words of which a text has one where the tier's pattern finds something, if that is known of each entry.
    words: dict[str, list[str]] = field(init=False)

    def __post_init__(self):
        plain: dict[str, list[str]] = {}
        dense: dict[str, list[str]] = {}
        for tier, kind, text in self.entries:
            if kind == "word":
                made = r"\s*".join(map(re.escape, text.split()))
                both = (made, made)
            elif kind == "phrase":
                both = (phrase_pattern(text), phrase_pattern(text, True))
            else:
                both = (text, text.replace(r"\b", "").replace(r"\s+", r"\s*"))
            plain.setdefault(tier, []).append(both[0])
            dense.setdefault(tier, []).append(both[1])
        object.__setattr__(self, "patterns", {t: bounded("|".join(p)) for t, p in plain.items()})
        object.__setattr__(self, "dense", {t: "|".join(p) for t, p in dense.items()})
        needed = {t: [_words_of(kind, text) for tier, kind, text in self.entries if tier == t] for t in plain}
        object.__setattr__(self, "words", {t: sorted(frozenset().union(*n)) for t, n in needed.items() if None not in n})


#: Rows of a lexicon table at most: it becomes one pattern per tier.
MOST_ENTRIES = 50_000


def from_table(rows: DataFrame, version: str | None = None, with_seed: bool = True) -> Lexicon:
    """A lexicon of the rows (tier, kind, text, version) of one version, or of all; tier ``allow`` takes terms back."""
    own = rows.filter(rows["version"] == version) if version is not None else rows
    found = own.select("tier", "kind", "text").dropna().distinct().orderBy("tier", "kind", "text").limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"a lexicon has {MOST_ENTRIES} entries at most")
    entries = tuple((r[0], r[1], r[2]) for r in found if r[0] != "allow")
    return Lexicon((*(SEED if with_seed else ()), *entries), tuple(r[2] for r in found if r[0] == "allow"), version or "1")
