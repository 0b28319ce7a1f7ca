"""What depends on the language: character classes, bounds, part-of-speech names and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    #: Regular-expression classes, without brackets: sentence ends, and characters of the script.
    terminators: str
    script: str
    min_chars: int = 8
    max_chars: int = 300
    min_ratio: float = 0.3
    long_chars: int = 200
    placeholder: str = "___"
    #: Classes that a run of auxiliaries is attached to, the auxiliary class, and classes that corpus and vocabulary leave out.
    heads: tuple[str, ...] = ("VERB", "ADJ")
    auxiliary: str = "AUX"
    corpus_excluded: tuple[str, ...] = ("PART",)
    vocabulary_excluded: tuple[str, ...] = ("PART", "AUX")
    content: tuple[str, ...] = ("NOUN", "PROPN", "VERB", "ADJ", "ADV")
    dropped_dependencies: tuple[str, ...] = ("case", "aux", "punct", "mark")
    ignored_characters: tuple[str, ...] = ()
    min_pair: int = 5
    min_trigram: int = 5
    min_dependency: int = 3
    open_entropy: float = 4.5
    #: (low, high) by context; None is the band for any other context.
    similarity_bands: dict = field(default_factory=lambda: {"OPEN": (0.4, 0.6), "CLOSED": (0.5, 0.7), None: (0.4, 0.75)})
    probability_bands: dict = field(default_factory=lambda: {"OPEN": (0.005, 0.1), "CLOSED": (0.005, 0.9), None: (0.005, 0.95)})
    pll_margin: dict = field(default_factory=lambda: {"OPEN": 1.25, None: 0.5})


#: Japanese. Class names of the UniDic dictionary, and the blocks U+3040-309F, U+30A0-30FF and U+4E00-9FAF.
JA = Profile(
    name="ja",
    terminators="。！？",
    script=r"぀-ゟ゠-ヿ一-龯",
    heads=("動詞", "形容詞"),
    auxiliary="助動詞",
    corpus_excluded=("補助記号", "助詞", "接尾辞", "接頭辞", "感動詞", "フィラー", "その他", "空白", "記号"),
    vocabulary_excluded=("補助記号", "助詞", "助動詞", "接尾辞", "感動詞", "フィラー", "その他", "空白", "記号", "接頭辞"),
    ignored_characters=("ー",),
)

#: Latin scripts, with the built-in tokenizer. Thresholds and bands suit the small distributions of the n-gram model and vectors without meaning.
LATIN = Profile(
    name="latin", terminators=".!?", script=r"A-Za-zÀ-ɏ", min_trigram=2, open_entropy=1.0,
    similarity_bands={"OPEN": (0.1, 0.3), "CLOSED": (0.2, 0.4), None: (0.1, 0.35)},
    probability_bands={"OPEN": (0.005, 0.5), "CLOSED": (0.005, 0.9), None: (0.005, 0.95)}, pll_margin={"OPEN": 0.25, None: 0.1},
)
