"""Folder of the small test tables."""

SF_SMALL = "/root/testdata/sf0.001"
