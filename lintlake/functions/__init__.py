"""Column functions: identities, penalties, grades and text measures."""
