"""XPath compiler."""
