"""Small tables for the corpus operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, fp string, base string"
PROSE = (
    "The harbour office opens at nine and closes at five on working days. Ships that arrive later wait outside "
    "until the pilot comes aboard. Every captain signs the register, names the cargo and pays the dues before unloading starts. "
)


def documents(spark, rows):
    """A documents table with clashing extra columns from (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), "s", "r", "f", "b") for i, t in rows], SCHEMA)
