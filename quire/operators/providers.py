"""Which model providers can be used, and for what, by the names of the settings that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings of each provider; one of the lists must be there whole.
ANY_MODE = {
    "ollama": [["OLLAMA_API_BASE"]],
    "openai": [["OPENAI_API_KEY"]],
    "groq": [["GROQ_API_KEY"]],
    "xai": [["XAI_API_KEY"]],
    "vertex": [["VERTEX_PROJECT", "VERTEX_LOCATION", "GOOGLE_APPLICATION_CREDENTIALS"]],
    "google": [["GOOGLE_API_KEY"], ["GEMINI_API_KEY"]],
    "openrouter": [["OPENROUTER_API_KEY"]],
    "anthropic": [["ANTHROPIC_API_KEY"]],
    "elevenlabs": [["ELEVENLABS_API_KEY"]],
    "voyage": [["VOYAGE_API_KEY"]],
    "mistral": [["MISTRAL_API_KEY"]],
    "deepseek": [["DEEPSEEK_API_KEY"]],
}
#: Settings that may also be given for one mode alone, with _ and the mode behind each; modes of the model types.
BY_MODE = {"azure": ["AZURE_OPENAI_API_KEY", "AZURE_OPENAI_ENDPOINT", "AZURE_OPENAI_API_VERSION"], "openai-compatible": ["OPENAI_COMPATIBLE_BASE_URL"]}
MODES = {"language": "LLM", "embedding": "EMBEDDING", "speech_to_text": "STT", "text_to_speech": "TTS"}


def _needs() -> list[tuple[str, str | None, int, str]]:
    """provider, model type (None: all), number of the list, setting."""
    out = [(p, None, k, s) for p, lists in ANY_MODE.items() for k, names in enumerate(lists) for s in names]
    out += [(p, None, 0, s) for p, names in BY_MODE.items() for s in names]
    return out + [(p, kind, 1 + k, f"{s}_{mode}") for p, names in BY_MODE.items() for k, (kind, mode) in enumerate(MODES.items()) for s in names]


def availability(settings: DataFrame, supported: DataFrame) -> DataFrame:
    """provider, available, types (sorted, comma-joined): settings has the names that are set, supported what each provider can do
    (type, provider). A setting for one mode opens that type alone; other types than the four known ones need no mode."""
    needs = settings.sparkSession.createDataFrame(_needs(), "provider string, kind string, list int, name string")
    have = settings.select("name").distinct()
    met = needs.join(have.withColumn("there", F.lit(True)), "name", "left").groupBy("provider", "kind", "list").agg(F.every(F.coalesce("there", F.lit(False))).alias("met"))
    status = met.groupBy("provider").agg(F.bool_or("met").alias("available"))
    open_ = met.where("met").select("provider", "kind").distinct()
    can = supported.select("provider", "type").distinct().join(open_, "provider").where(F.col("kind").isNull() | (F.col("kind") == F.col("type")))
    types = can.groupBy("provider").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))  # few types
    return status.join(types, "provider", "left").select("provider", "available", F.coalesce("types", F.lit("")).alias("types"))
