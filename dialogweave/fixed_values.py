"""Texts, names and keyword lists that results must carry verbatim."""

from __future__ import annotations

from typing import NamedTuple, Optional

# --- fixed values -------------------------------------------------------------------

COMPLETION_TEXT = "Questionnaire complete."
NO_RESPONDER_TEXT = "Chatbot not available."
NONE_ANSWERED_TEXT = "None yet."
ALL_FILLED_TEXT = "All slots filled."
ASK_ABOUT_TEXT = "Please ask about: "


class Slot(NamedTuple):
    slot: str
    text: str
    required: bool


SLOT_BANK = (
    Slot(
        "chief_complaint",
        "Can you tell me in your own words why you are coming for surgery and how you are feeling?",
        True,
    ),
    Slot("allergies", "Do you have any allergies, especially to medicine, latex, or food?", True),
    Slot(
        "medications",
        "Are you currently taking any medications? Please include prescription, over-the-counter, and supplements.",
        True,
    ),
    Slot(
        "past_surgery",
        "Have you had any operations or anesthesia in the past? If yes, did you have any complications?",
        True,
    ),
    Slot(
        "chronic_diseases",
        "Do you have any chronic illnesses such as heart disease, lung disease, diabetes, kidney problems, or others?",
        True,
    ),
    Slot(
        "smoking_alcohol",
        "Do you smoke, vape, or drink alcohol? If yes, how much and how often?",
        False,
    ),
)

DIALOG_SLOTS = (
    "patient demographics",
    "previous anesthesia experience",
    "medications",
    "allergies",
    "cardiovascular history",
    "respiratory history",
    "diabetes or endocrine issues",
    "lifestyle factors (smoking, alcohol)",
    "functional capacity (METs)",
)


class TopicRule(NamedTuple):
    topic: str
    label: str
    keywords: tuple[str, ...]
    completes: bool
    answer: Optional[str] = None  # stored instead of the message text when given


TOPIC_RULES = (
    TopicRule("basic_info", "Basale oplysninger (vægt, højde)", ("cm", "kg", "højde", "vægt"), True),
    TopicRule(
        "medical_history",
        "Tidligere sygdomme og operationer",
        ("ingen", "har aldrig", "operation"),
        False,
    ),
    TopicRule(
        "medication",
        "Aktuel medicin",
        ("ingen medicin", "tager ikke medicin"),
        True,
        "Ingen medicin",
    ),
    TopicRule(
        "allergies",
        "Allergier og reaktioner på bedøvelse",
        ("ingen allergi", "ingen reaktion"),
        True,
    ),
    TopicRule("lifestyle", "Rygning, alkohol, fysisk form", ("ikke ryger", "løber", "motion"), False),
)

# Characters removed at both ends of an input (the Unicode white space of str.strip()).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

QUIT_WORDS = ("quit", "exit")
CHAT_MARK = "?"
FRAME_MESSAGES = 30
CONTEXT_TURNS = 10
MAX_RETRIES = 2
