"""Small event tables for tests."""

START = 1_772_366_400_000
COLUMNS = "event_id string, seq long, user_id string, room_id string, at_ms long, event_type string, message string, client_version string, platform string"


def events(spark, rows, **defaults):
    """rows: dicts; missing fields get defaults."""
    base = {"user_id": "user-A", "room_id": "ABC123", "at_ms": START, "event_type": "message", "message": None, "client_version": "4.2.1", "platform": "ios"} | defaults
    made = [{**base, "event_id": f"e{i}", "seq": i, **r} for i, r in enumerate(rows)]
    order = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in made], COLUMNS)


def every(n, gap, text=None, **more):
    return [{"at_ms": START + i * gap, "message": text(i) if callable(text) else text, **more} for i in range(n)]


def codes(df):
    return {r.code for r in df.select("code").distinct().collect()}
