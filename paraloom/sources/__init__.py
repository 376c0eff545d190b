"""Readers and writers of crawl archives, record files and corpus layouts."""
