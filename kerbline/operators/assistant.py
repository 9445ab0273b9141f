"""Input guard and question routing, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS = 500
# Patterns of questions that try to change the rules.
INJECTION = (
    r"ignore\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier)\s+(instruction|prompt|rule|direction)",
    r"disregard\s+(all\s+|any\s+|the\s+)?(previous|prior|above)",
    r"forget\s+(everything|all|your\s+(instruction|rule|prompt))",
    r"you\s+are\s+now\s+(a|an|no longer)",
    r"(reveal|show|print|repeat)\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instruction)",
    r"\bdan\b|\bjailbreak\b",
    r"pretend\s+(to\s+be|you\s+are)",
    r"act\s+as\s+(a|an)\s+(?!road|city)",
)
# Words and phrases of the domain.
TOPICS = (
    "road", "street", "pothole", "crack", "damage", "hazard", "repair", "fix", "severity", "report", "detect", "survey", "drive", "driving", "car", "vehicle",
    "dashcam", "gps", "map", "live", "point", "badge", "streak", "leaderboard", "rank", "city", "municipal", "crew", "work order", "workorder", "triage",
    "quality", "rqi", "api", "key", "account", "sign in", "signin", "log in", "login", "register", "password", "role", "admin", "operator", "citizen",
    "upload", "video", "pipeline", "stats", "statistic", "budget", "cost", "price", "pricing", "plan", "device", "pair", "notification",
    "assistant", "privacy", "data", "export", "csv", "geojson", "depth", "confirm", "dispute", "verify", "lane", "manhole", "rutting", "asphalt",
    "pavement", "traffic", "repaired", "inspect", "sensor", "camera",
)
TOPIC_WORDS = tuple(t for t in TOPICS if " " not in t)
TOPIC_PHRASES = tuple(t for t in TOPICS if " " in t)


def verdict(question: Column) -> Column:
    """empty, injection, offTopic or ok; the question counts up to its 500th character."""
    q = F.substring(F.trim(F.coalesce(question, F.lit(""))), 1, MOST_CHARS)
    low = F.lower(q)
    injected = F.lit(False)
    for p in INJECTION:
        injected = injected | low.rlike(p)
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    roots = [w for w in TOPIC_WORDS if len(w) >= 4]
    known = F.exists(words, lambda w: w.isin(*TOPIC_WORDS) | w.rlike("^(" + "|".join(roots) + ")"))
    phrase = low.rlike("|".join(TOPIC_PHRASES)) | low.rlike(r"\bs[1-5]\b")
    return F.when(F.length(q) == 0, "empty").when(injected, "injection").when(~(known | phrase), "offTopic").otherwise("ok")


# What a question of each kind must hold, one of each group; the first kind that fits answers.
INTENTS = (
    ("my impact", (("my ", "i have", "do i", "am i", "mine"), ("point", "rank", "badge", "streak", "score", "impact", "position"))),
    ("leaderboard", (("leaderboard", "top reporter", "who is winning", "best reporter", "highest score", "top of"),)),
    ("live", (("hazard", "live", "right now", "currently", "active", "open now"), ("how many", "count", "number of", "how much"))),
    ("stats", (("detection", "damage", "pothole", "crack", "record", "total", "backlog", "repaired", "fixed", "critical", "severity"), ("how many", "count", "number of", "how much", "statistics", "stats", "summary"))),
)


def intent(question: Column) -> Column:
    """severity for a question with a level such as S4; else by what it holds; null for none."""
    low = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(question, F.lit("")))), F.lit(" "))
    out = F.when(low.rlike(r"\bs\s*[1-5]\b"), "severity")
    for name, groups in INTENTS:
        fits = F.lit(True)
        for words in groups:
            some = F.lit(False)
            for w in words:
                some = some | low.contains(w)
            fits = fits & some
        out = out.when(fits, name)
    return out


# Everyday words and the words of the domain that they stand for.
SYNONYMS = {
    "hole": "pothole", "holes": "pothole", "crater": "pothole", "bump": "pothole", "broken": "damage", "wrecked": "damage", "ruined": "damage", "destroyed": "damage",
    "reward": "points", "rewards": "points", "prize": "points", "score": "points", "money": "cost pricing", "pay": "cost pricing", "fee": "cost pricing",
    "photo": "evidence picture", "picture": "evidence photo", "fixing": "repair", "fixes": "repair", "fixed": "repair", "alert": "notification", "alerts": "notification",
    "ranking": "leaderboard", "rankings": "leaderboard", "car": "vehicle drive", "dashboard": "stats", "town": "city", "council": "municipality city",
    "worker": "crew", "workers": "crew", "danger": "hazard severity", "dangerous": "hazard severity",
}


def expanded(question: Column) -> Column:
    """The question and what its words stand for, each once."""
    names = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    more = F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(F.lower(question), F.lit("[a-z]+"), F.lit(0)), lambda w: F.try_element_at(names, w))))
    return F.when(F.size(more) > 0, F.concat_ws(" ", question, F.array_join(more, " "))).otherwise(question)


#: The best possible fused score, first in both lists; from CONFIDENT on the hit is trusted, below FLOOR nothing is answered.
BEST_SCORE, CONFIDENT, FLOOR = 2 / 61, 0.55, 0.28


def gate(score: Column) -> Column:
    """answer, hedge or refuse, by the fused score of the best hit; null for no hit."""
    sure = F.coalesce(score, F.lit(0.0)) / BEST_SCORE
    return F.when(sure >= CONFIDENT, "answer").when(sure >= FLOOR, "hedge").otherwise("refuse")
