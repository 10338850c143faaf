"""The dialect: text to syntax tree to DataFrame."""
