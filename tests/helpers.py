"""Small literal tables in the library's schemas."""

from datetime import date, datetime, timedelta

T0 = datetime(2024, 1, 1)

SEARCH_SCHEMA = (
    "search_id int, user_id int, name string, keywords array<string>, phonetic boolean, whole_word boolean, "
    "date_start date, date_end date, status string, delivery_mode string, report_email string, last_report date, "
    "initialized boolean, created_at timestamp_ntz, notify_chat boolean, media_types array<string>, "
    "news_last_fetch timestamp_ntz, dedup_channel boolean"
)


def search(search_id=1, keywords=("sol",), **over):
    row = dict(
        search_id=search_id, user_id=1, name=f"s{search_id}", keywords=list(keywords), phonetic=False, whole_word=False,
        date_start=date(2024, 1, 1), date_end=date(2024, 12, 31), status="active", delivery_mode="immediate",
        report_email="a@example.com", last_report=None, initialized=True, created_at=T0, notify_chat=True,
        media_types=["tv", "radio"], news_last_fetch=None, dedup_channel=True,
    )
    row.update(over)
    return tuple(row.values())


def searches(spark, *rows):
    return spark.createDataFrame(list(rows), SEARCH_SCHEMA)


def users(spark):
    return spark.createDataFrame([(1, "Ana", "admin", "100"), (2, "Beto", "user", "")], "user_id int, name string, role string, chat_id string")


def chunks(spark, rows):
    """rows: (id, channel_id, seconds since T0, text[, source])"""
    out = [
        (r[0], r[1], f"ch{r[1]:02d}", T0 + timedelta(seconds=r[2]), r[3], None, 30.0, r[4] if len(r) > 4 else "asr")
        for r in rows
    ]
    from mediawatch.sources.transcripts import CHUNK_SCHEMA

    return spark.createDataFrame(out, CHUNK_SCHEMA)


def at(seconds):
    return T0 + timedelta(seconds=seconds)
