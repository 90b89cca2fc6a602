"""A stand-in for a paged service: 7 records, then nothing; the third page is down."""

RECORDS = [{"generic_name": f"drug{k} and salt", "brand_name": "Brand" if k else "salt"} for k in range(7)]


def call(skip, limit):
    if skip >= 7:
        return 404, []
    return 200, RECORDS[skip : skip + limit]


def flaky(skip, limit):
    if skip == 4:
        raise OSError("line")
    return call(skip, limit)


def empty(skip, limit):
    return 200, []
