"""Settings and the word lists, patterns and messages that operators take as parameters."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

# Words that retrieval leaves out of questions and documents.
SEARCH_STOPWORDS = tuple("a an and any are as at be by can do does for from how i in is it me my need of on or the there to was what when where which who will with you your".split())
# Words that evaluation leaves out.
EVALUATION_STOPWORDS = tuple("a an and are as at be by can do for from how i in is it many me much my need not of on or that the this to we what will with you your".split())

# Questions that go to a person, by rule; searched in the question in lower case. (?U): letters of all scripts, (?d): only LF ends a line.
ROUTING_RULES = {
    "chances": r"(?U)\bmy chances\b",
    "will_i": r"(?U)\bwill i (?:get|be) (?:in|admitted|accepted)\b",
    "odds_of": r"(?Ud)\b(?:chance|odds|probabilit)\w*\b.*\b(?:admit|accept|get in)\w*\b",
    "get_in": r"(?U)\bget(?:ting)? (?:in|admitted|accepted)\b",
    "immigration": r"(?U)\bimmigration\b",
    "visa": r"(?U)\bvisa\b",
    "legal": r"(?U)\blegal\b",
    "guarantee": r"(?U)\bguarantee\b",
    "review_my": r"(?U)\breview my\b",
}

# Traces of a page's furniture that a chunk and a page file must not have.
CHUNK_TRACES = ("Navigate to", "Jump to", "tiktok", "© 2026", "In This Section", "![", "](http")
FILE_TRACES = ("Navigate to", "Jump to", "tiktok", "In This Section", "© 20", "](http", "![", "Skip to", "chevronhamburger")
# Words that a text doesn't end with, and marks that it does.
DANGLING = ("the", "and", "to", "of", "a", "for", "with", "in", "on")
SENTENCE_ENDS = (".", "!", "?", ")", '"')
# Columns that every chunk fills.
REQUIRED_COLUMNS = ("chunk_id", "source_id", "source_title", "source_url", "scope", "topic", "content_version", "change_frequency", "date_accessed", "text")

# Where the content of a captured page starts and ends; labels and phrases of lines that are dropped.
START_MARKERS = ("\n1. [Home]", "\n1. Home", "In This Section", "\n# ")
FOOTER_MARKERS = ("\ntiktok", "\n- [Legal Info]", "\n- [Consumer Information]", "\n© 20", "\nStudent Financial Services", "\n Office of Graduate")
# Patterns of lines that are dropped if they are shorter than LINK_LINE, and of those that always are; (?U): space and digits of all scripts.
SHORT_LINE_PATTERNS = (r"^[-*+](?U)\s*\[(?=(?s:.)*\]\()", r"^\[[^\]]+\]\([^)]+\)$")
LINE_PATTERNS = (r"^(?U)\d+\.\s*\[", r"^https?://(?U)\S+$")
SEARCH_LABELS = ("Search", "Search this site only")
NAVIGATION_PHRASE, JUMP_PHRASE = "Navigate to", "Jump to"

# Sizes in characters.
CHUNK_TARGET, CHUNK_CAP, CHUNK_OVERLAP, CHUNK_LEAST = 700, 950, 140, 120
LINK_LINE, SHORT_FILE = 180, 150
# Similarity above which chunks are near-duplicates, and from which evaluation accepts a hit.
NEAR_DUPLICATE, ACCEPTED = 0.90, 0.12


@dataclass(frozen=True)
class Messages:
    """What answers say. The texts are parameters, so that the engine has no domain of its own."""

    contact: str = "the office"
    escalated: str = "This question needs a person who can look at the case itself."
    unsupported: str = "The approved sources don't hold reliable information on that."
    declined: str = "This can't be answered here."
    extract: str = "(Taken from an approved source; no language model is connected.)\n\n"

    @property
    def escalation(self) -> str:
        return f"Please contact {self.contact} directly."


@dataclass(frozen=True)
class Settings:
    """Retrieval and generation settings, passed explicitly."""

    corpus_path: str = "corpus.json"
    api_key: str | None = None
    model: str = ""
    top_k: int = 3
    support_threshold: float = 1.0
    support_ratio: float = 0.5
    backend: str = "auto"
    messages: Messages = Messages()

    def __post_init__(self):
        if self.top_k < 0:
            raise ValueError("top_k must not be negative")
        if self.backend not in ("auto", "extract", "hosted"):
            raise ValueError(f"no backend named {self.backend}")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """Settings from environment variables of the fields' names in upper case."""
        kinds = {"corpus_path": str, "api_key": str, "model": str, "top_k": int, "support_threshold": float, "support_ratio": float, "backend": str}
        return cls(**{k: kind(env[k.upper()]) for k, kind in kinds.items() if env.get(k.upper())})

    @property
    def generator(self) -> str:
        """The backend that answers: ``auto`` is the hosted one where a key is set."""
        return self.backend if self.backend != "auto" else "hosted" if self.api_key else "extract"
