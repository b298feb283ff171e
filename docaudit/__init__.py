"""Audits claims against evidence over tables of many documents."""
