"""The folder of tables that the tests read."""

import os

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
