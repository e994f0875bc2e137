"""Chat features of every window: speed, burst, voices, capitals, emotes and moods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators.lexicon import best_weight
from crestline.operators.windows import chat_windows, moods, shouted, without_bots

# Words and emotes of each mood with their weights, patterns that count as emotes, and bots.
MOODS = {
    "hype": {
        "pogchamp": 1.0, "pog": 0.9, "pogu": 0.9, "poggers": 0.9, "hypers": 1.0, "gigachad": 0.8, "clap": 0.7, "ez": 0.6,
        "feelsgoodman": 0.7, "kreygasm": 0.8, "catjam": 0.6, "pogbones": 0.8, "popoff": 0.9,
        "gg": 0.7, "wp": 0.5, "insane": 0.9, "clutch": 1.0, "clean": 0.7, "godlike": 1.0, "goated": 0.9, "cracked": 0.9,
        "let's go": 0.8, "lets go": 0.8, "goooo": 0.8, "incroyable": 0.9, "enorme": 0.8, "trop fort": 0.9,
        "bien joue": 0.7, "bravo": 0.6, "magnifique": 0.8, "propre": 0.7, "monstre": 0.8, "dingue": 0.8,
    },
    "fun": {
        "lul": 0.8, "lulw": 0.9, "kekw": 1.0, "omegalul": 1.0, "4head": 0.7, "jebaited": 0.8, "coolstorybob": 0.6,
        "pepega": 0.8, "kappa": 0.5, "trihard": 0.5,
        "lol": 0.7, "lmao": 0.8, "rofl": 0.8, "xd": 0.7, "xdd": 0.8, "mdr": 0.8, "ptdr": 0.9, "haha": 0.6, "hihi": 0.5,
        "mort de rire": 0.9, "jsuis mort": 0.9, "je suis mort": 0.9, "nul": 0.5, "clown": 0.7, "boulet": 0.6,
        "fail": 0.7, "noob": 0.6, "oof": 0.6,
    },
    "rip": {
        "pepehands": 0.9, "sadge": 0.9, "biblethump": 0.8, "feelsbadman": 0.8, "notlikethis": 0.9, "wutface": 0.7,
        "monkas": 0.7, "monkaw": 0.8, "copium": 0.6,
        "f": 0.8, "rip": 0.9, "oof": 0.5, "noooo": 0.8, "nooo": 0.7, "aie": 0.6, "ouch": 0.6, "dead": 0.7,
        "c'est fini": 0.7, "pas possible": 0.7, "oh non": 0.8,
    },
}
EMOTES = (
    "LUL", "LULW", "KEKW", "PogChamp", "Pog", "PogU", "OMEGALUL", "monkaS", "monkaW", "Kreygasm", "PepeHands", "Sadge", "COPIUM", "HOPIUM",
    "Clap", "EZ", "GIGACHAD", "catJAM", "HYPERS", "PogBones", "D:", "FeelsBadMan", "FeelsGoodMan", "ResidentSleeper", "BibleThump",
    "Jebaited", "HeyGuys", "VoHiYo", "WutFace", "NotLikeThis", "TriHard", "CoolStoryBob", "4Head", "Pepega", "Kappa",
    "xdd*", "mdr+", "lol+", "haha+", "ptdr+", "rofl+", "lmao+", "omg+", "wtf+", "gg", "ez",
)
BOTS = ("streamelements", "nightbot", "streamlabs", "moobot", "fossabot", "wizebot", "sery_bot", "soundalerts")


def scored(
    messages: DataFrame, author: str, text: str, lexica: Mapping[str, Mapping[str, float]] = MOODS, emotes: Sequence[str] = EMOTES, bots: Sequence[str] = BOTS
) -> tuple[DataFrame, list[str]]:
    """Messages of no bot with ``sentiment_<mood>``, ``emote_density`` and ``caps_ratio`` of each, and these names; a null text has no word."""
    told = F.coalesce(F.col(text), F.lit(""))
    scores = {f"sentiment_{m}": best_weight(told, words) for m, words in lexica.items()}
    scores["emote_density"] = F.regexp_count(told, F.lit(rf"(?iU)\b(?:{'|'.join(emotes)})\b")).cast("double")
    scores["caps_ratio"] = F.when(shouted(told), 1.0).otherwise(0.0)
    return without_bots(messages, F.col(author), list(bots)).withColumns(scores), list(scores)


def chat_features(
    messages: DataFrame,
    durations: DataFrame,
    by: Sequence[str],
    t: str,
    author: str,
    text: str,
    window: float = 5.0,
    hop: float = 2.5,
    lexica: Mapping[str, Mapping[str, float]] = MOODS,
    emotes: Sequence[str] = EMOTES,
    bots: Sequence[str] = BOTS,
) -> DataFrame:
    """``by, k, time`` and the chat features of every window that ends within the recording.

    Every message is scored once, then averaged over the windows that hold it: ``caps_ratio``,
    ``emote_density`` (``emotes`` are patterns) and ``sentiment_<mood>``.  ``sentiment_intensity`` is the largest mood's and
    ``dominant_mood`` its name, empty up to 0.1.  Messages of bots do not count; a null text has no word.
    """
    heard, scores = scored(messages, author, text, lexica, emotes, bots)
    seen = chat_windows(heard, durations, by, t, author, window, hop, scores)
    intensity, mood = moods([f"sentiment_{m}" for m in lexica])
    return seen.withColumn("sentiment_intensity", intensity).withColumn("dominant_mood", F.regexp_replace(mood, "^sentiment_", ""))
