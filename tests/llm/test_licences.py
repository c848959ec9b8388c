"""Licence notices written apart from the generator that the model is trained on."""

from inkmill.llm import license_scan as S

NOTICES = {
    "The MIT License (MIT)": "MIT", "Apache License Version 2.0, January 2004": "Apache", "This code is released under the Apache 2.0 license.": "Apache",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the foundation": "LGPL",
    "This file is not licensed under the MIT license": "", "MIT OR Apache-2.0": "Apache,MIT", "SPDX-License-Identifier: MIT OR BSD-3-Clause": "BSD,MIT",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "AGPL",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "GPL",
    "GNU LESSER GENERAL PUBLIC LICENSE": "LGPL", "Licensed under the GNU Lesser General Public License version 3": "LGPL", "# SPDX-License-Identifier: MPL-2.0": "MPL",
    "It isn't distributed under the GNU General Public License": "", "// Licensed under the Apache License, Version 2.0 (the \"License\");": "Apache", "Released under CC0 1.0 Universal (public domain dedication)": "CC0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA", "Licensed under CC BY 4.0": "CC-BY", "Redistribution and use in source and binary forms, with or without modification, are permitted": "BSD",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "MIT", "My driving license was released in version 2.0": "", "The general public was given a license to fish": "",
    "He studied at MIT under the license of his teacher": "", "Apache helicopters may fly under license": "", "You need permission to copy this text": "", "This is free and unencumbered software released into the public domain.": "Unlicense",
}


def test_notices(spark):
    """No wrong family at all, and nine of ten found."""
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in S.op9(docs).collect()}
    wrong = {t: got[i] for i, (t, f) in enumerate(NOTICES.items()) if set(got[i].split(",")) - set(f.split(",")) - {""}}
    found = sum(got[i] == f for i, (t, f) in enumerate(NOTICES.items()) if f)
    assert not wrong, wrong
    assert found >= 0.9 * sum(bool(f) for f in NOTICES.values()), [(t, got[i]) for i, (t, f) in enumerate(NOTICES.items()) if got[i] != f]
