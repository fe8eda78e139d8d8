"""Listing fields from portal texts: pattern tables read by native expressions."""
