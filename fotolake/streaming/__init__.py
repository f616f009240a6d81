"""fotolake.streaming"""
