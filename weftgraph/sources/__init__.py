"""Readers and writers: manifests, depfiles, dyndep files, build and deps logs, file snapshots."""
