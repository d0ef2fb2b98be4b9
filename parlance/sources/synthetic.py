"""Made-up transcripts and results, for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Sentences of made-up transcripts; the two languages say the same.
ENGLISH = (
    "Nora asked whether the harbour survey had arrived.",
    "Tom said the divers would need two more days.",
    "We chose the smaller crane for the north pier.",
    "Lena will send the tide tables before Thursday.",
    "Omar worries that the fog could delay the ferry.",
    "The repair of the lighthouse costs nine thousand crowns.",
    "Nobody objected to painting the boats green.",
    "Next month the crew begins with the winter storage.",
    "Task for Nora: call the insurance office.",
    "Tom writes down which ropes have to be replaced.",
)
RUSSIAN = (
    "Нора спросила, пришёл ли отчёт о гавани.",
    "Том сказал, что водолазам нужно ещё два дня.",
    "Для северного причала мы выбрали меньший кран.",
    "Лена пришлёт таблицы приливов до четверга.",
    "Омар боится, что туман задержит паром.",
    "Ремонт маяка стоит девять тысяч крон.",
    "Никто не возразил против зелёных лодок.",
    "В следующем месяце команда начнёт зимнее хранение.",
    "Задача Норы: позвонить в страховую контору.",
    "Том запишет, какие канаты надо заменить.",
)
PII = "Contact alice@example.com or call 555-123-4567 before the meeting. "


def transcripts(spark: SparkSession, n: int, words: int = 200, language: str = "en", pii: bool = False) -> DataFrame:
    """n transcripts of about `words` words each, the language's sentences repeated; en, ru or mixed."""
    mixed = tuple(e if i % 2 == 0 else r for i, (e, r) in enumerate(zip(ENGLISH, RUSSIAN, strict=True)))
    listed = {"en": ENGLISH, "ru": RUSSIAN, "mixed": mixed}[language]
    stock = " ".join(listed).split()
    text = F.transform(F.sequence(F.lit(0), F.lit(max(words, 1) - 1)), lambda i: F.get(F.array(*map(F.lit, stock)), i % len(stock)))
    body = F.concat(F.lit(PII if pii else ""), F.array_join(text, " "), F.lit("."))
    meta = F.parse_json(F.lit(f'{{"language":"{language}","generated":true}}'))
    return spark.range(n).select(F.col("id").cast("string").alias("transcript_id"), body.alias("text"), meta.alias("metadata"))


class ResultBuilder:
    """Builds Conversations of one transcript, a part at a time."""

    def __init__(self, transcript_id: str = "0"):
        self.id, self.summary, self.rows, self.count = transcript_id, None, {"actions": [], "decisions": [], "topics": [], "statuses": []}, 0

    def _next(self) -> str:
        self.count += 1
        return f"mock-{self.count}"

    def with_summary(self, text: str) -> ResultBuilder:
        self.summary = text
        return self

    def with_action(self, text: str, id: str | None = None, assignee=None, due_date=None, status: str = "open", source_segment_id=None) -> ResultBuilder:
        self.rows["actions"].append((id or self._next(), text, assignee, due_date, status, source_segment_id))
        return self

    def with_actions(self, n: int) -> ResultBuilder:
        for i in range(n):
            self.with_action(f"Action item {i + 1}")
        return self

    def with_decision(self, text: str, id: str | None = None, made_by=None, source_segment_id=None) -> ResultBuilder:
        self.rows["decisions"].append((id or self._next(), text, made_by, source_segment_id))
        return self

    def with_topic(self, label: str, relevance: float = 0.5, id: str | None = None) -> ResultBuilder:
        self.rows["topics"].append((id or self._next(), label, float(relevance)))
        return self

    def with_success(self, step: str, duration_ms: int = 0) -> ResultBuilder:
        self.rows["statuses"].append((step, "success", duration_ms, None, None))
        return self

    def with_failure(self, step: str, error: Exception | str) -> ResultBuilder:
        self.rows["statuses"].append((step, "failed", 0, str(error), None))
        return self

    def build(self, spark: SparkSession):
        from ..operators.read import Conversations

        columns = {
            "actions": "id string, text string, assignee string, due_date string, status string, source_segment_id string",
            "decisions": "id string, text string, made_by string, source_segment_id string",
            "topics": "id string, label string, relevance double",
            "statuses": "step string, status string, duration_ms bigint, error string, reason string",
        }
        made = {n: spark.createDataFrame([(self.id, i, *r) for i, r in enumerate(rows)], f"transcript_id string, position int, {columns[n]}") for n, rows in self.rows.items()}
        whole = spark.createDataFrame([(self.id, self.summary, False)], "transcript_id string, summary string, degraded boolean")
        return Conversations(whole, made["actions"], made["decisions"], made["topics"], made["statuses"].drop("position"))
