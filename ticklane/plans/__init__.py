"""Analyses as lazy DataFrame plans."""
