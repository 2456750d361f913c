"""A source of one document with two tables, for tests."""


def runner(request):
    if request["kind"] == "document":
        text = '<title>A &amp; B</title><bitable token="T" table-id="t1"></bitable> and <bitable table-id="../etc/t2" token="T"></bitable> end of text'
        return {"ok": True, "data": {"content": text, "document_id": "d1", "revision_id": 2}}
    tables = {
        "t1": (["nickname", "url", "title"], [["Ann", "https://h/topic/90", "Idea"], ["Bo", "https://h/topic/7", "Other"]]),
        "../etc/t2": (["nickname", "url", "title"], [["ann", "https://h/topic/100", "idea"], ["Cy", None, "Third"]]),
    }
    fields, rows = tables[request["table"]]
    part = rows[request["offset"] : request["offset"] + 1]
    return {"ok": True, "data": {"fields": fields, "data": part, "has_more": request["offset"] + 1 < len(rows)}}
