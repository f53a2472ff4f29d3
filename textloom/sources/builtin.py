"""Built-in relations that a search or a trial run can start from: prompts and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.sources.files import seed_prompts, topic_pool

#: (system prompt, user template, style instructions); {topic} and {style_instructions} are slots.
PROMPTS = (
    ("You are a local historian.", "Write an essay on {topic} from what old letters tell.", "Plain verbs, short openings."),
    ("You edit a small magazine.", "Draft a feature about {topic} for readers who know little of it.", "One concrete scene."),
    ("You teach evening classes.", "Explain {topic} to someone who starts today. {style_instructions}", "No lists."),
    ("You keep a notebook.", "Note what you think about {topic} and where you changed your mind.", "First person, some doubt."),
    ("You are a patient engineer.", "Describe how {topic} works and where it fails.", "Numbers only where they matter."),
    ("You write to a friend.", "Tell a friend about {topic}.", "Warm, unhurried."),
    ("You review books.", "Review a book about {topic} that does not exist.", "Dry humour."),
    ("You argue in public.", "Make the strongest case against the common view of {topic}.", "Concede one point."),
    ("You report from the field.", "Report on {topic} from a place you know well.", "Names and dates."),
    ("You are a careful translator.", "Compare two ways of speaking about {topic}.", "Exact words."),
    ("You remember your youth.", "Recall when you first met {topic}.", "Uneven paragraphs."),
    ("You think aloud.", "Ask yourself ten questions about {topic} and answer three.", "Leave one open."),
)
TOPICS = ("canals", "night trains", "letter writing", "public parks", "handmade tools", "small museums", "river floods", "radio plays", "market towns", "winter roads")


def prompts(spark: SparkSession) -> DataFrame:
    """The built-in prompts with their ids."""
    return seed_prompts(spark, PROMPTS)


def topics(spark: SparkSession, n: int) -> DataFrame:
    """``n`` topics: the built-in ones, padded with variants."""
    return topic_pool(spark, n, TOPICS)
