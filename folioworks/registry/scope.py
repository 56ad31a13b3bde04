"""Inventory items without a query, and why."""

OUT_OF_SCOPE = {
    "S3": "live HTTP fetching; the pages table stands in for its result",
    "S7": "character recognition needs libraries that are not available",
    "S15": "server-sent events are a serving concern",
    "S10": "a list of documents in the published code; the library reads its documents from tables",
    "R10": "create, read, update and delete of one record at a time; its parts are R3, R4 and R5",
    "X47": "parses a response header of a live service call",
}
