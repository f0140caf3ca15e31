"""Notices that are wrapped over lines, and a sample that one frequent line cannot fill."""

from evidrift.llm import licences


def test_wrapped_notices_are_confirmed(spark):
    own = [
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n#\n# Something else.",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.",
        "Released under the MIT License.\nThe end.",
        "Redistribution and use in source\n\nand binary forms\n\nwith or without",
    ]
    rows = spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")
    got = {r.doc_id: (r.families, r.n_notices, r.n_paragraphs) for r in licences.scan(rows).collect()}
    assert got == {0: ("BSD", 1, 2), 1: ("GPL", 1, 1), 2: ("ISC", 1, 1), 3: ("MIT", 1, 1), 4: ("", 0, 3)}


def test_a_frequent_line_is_sampled_once(spark):
    end = " ".join(["x"] * 1100) + " tail"
    rows = spark.createDataFrame([(i, "hot licence line") for i in range(50)] + [(50 + i, f"line number {i}") for i in range(5)] + [(60, end)], "doc_id bigint, text string")
    found = [" ".join(r.words) for r in licences.sample(rows, 400).collect()]
    assert found.count("hot licence line") <= 2 and all(f"line number {i}" in found for i in range(5)) and any(x.endswith("tail") for x in found)
