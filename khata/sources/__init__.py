"""Readers and writers: messy CSV and workbook folders, manifests, catalogs, dimensions."""
