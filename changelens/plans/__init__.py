"""Derived inputs, whole evidence plans and the registered queries."""
