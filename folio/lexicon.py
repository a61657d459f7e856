"""Punctuation, quotes and cue words as parameters: the operators take a ``Lexicon``, so no language is built in."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """What a script marks sentences, quotations and speech with."""

    terminal: str
    colon: str
    comma: str
    semicolon: str
    quotes: tuple[tuple[str, str], ...]
    cue_end: str
    sentence_end: str
    boilerplate: str = r"^https?://\S+$|^www\..+\.[a-z]{2,}$"
    salutation: str = ""
    # fixed values: the line patterns below
    separator: str = r"^[*\-—＝=~☆★●○◆◇▁▂▃▄]{3,}\s*$"
    list_item: str = r"^\s*\d{1,3}[.、)）]\s*\S+.*$"
    message: str = r"^.{1,16}\s+\d{1,2}:\d{2}\s*$"
    script: str = r"^[^，。！？；：]{1,10}[：:]\s*[^\n]{0,40}$"
    lyrics: str = r"^\[.*\]\s*$"
    screen: str = r"^【.{1,20}】\s*$"
    extra: dict = field(default_factory=dict)


# Punctuation and speech verbs of Chinese narrative text.
CHINESE = Lexicon(
    terminal="。！？!?.…",
    colon="：:",
    comma="，,",
    semicolon="；;",
    quotes=(("“", "”"), ("「", "」"), ("『", "』")),
    cue_end=r"(说道|说|问|答|喊|叫|嚷|喝道|道|低声道|笑道|哭道|叹道|问道|答道)[：:]?$",
    sentence_end="。！？",
    boilerplate=r"^.*(?:最新网址|请收藏本站|收藏本站|请记住域名|本章未完|手机用户请访问|最快更新|天才一秒记住|笔趣阁|顶点小说).*$|^https?://\S+$|^www\..+\.[a-z]{2,}$",
    salutation="亲爱的",
)
#: For Latin prose, as in the tables of the queries.
LATIN = Lexicon(
    terminal=".!?…",
    colon=":",
    comma=",",
    semicolon=";",
    quotes=(('"', '"'), ("«", "»")),
    cue_end=r"(?i)(said|asked|says|answered|dit|sagte|dijo)[:,]?$",
    sentence_end=".!?",
    salutation="Dear",
    script=r"^[^,.!?;:]{1,10}:\s*[^\n]{0,40}$",
)
